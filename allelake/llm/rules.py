"""Quality rules as a bitmask ledger (operator 4), with DataFrame functions only.

Every rule is evaluated once: the ledger holds the measurements of each document and one bit for each rule that it
fails. A policy is a named, versioned mask over these bits, so another policy or an ablation reads the ledger alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = r"[#*$%&|<>]"
#: Rules in the order of their bits: name, and the condition under which a document fails, over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    ("many_words", "n_words > 200000"),
    ("bullets", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
    ("few_letters", "10 * n_letter_words < 8 * n_words"),
    ("few_stop_words", "n_stop_words < 2"),
)
#: Marks that open an item of a list, and frequent English words, two of which a text of that language has.
BULLETS, STOP_WORDS = ("-", "*", "•", "‣", "▪"), ("the", "be", "to", "of", "and", "that", "have", "with")
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BITS[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
#: Length alone says nothing about quality, and stop words only about English: these bits are for policies that ask for them.
DEFAULT = Policy("default", 2, tuple(r for r in BITS if r not in ("many_words", "few_stop_words")))
ENGLISH = Policy("english", 1, (*DEFAULT.rules, "few_stop_words"))


def measures(text: Column) -> dict[str, Column]:
    """The array columns that measurements start from."""
    return {
        "words": F.filter(F.split(text, common.WORD_BREAK), lambda w: w != ""),
        "lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(common.SPACE))) > 0),
    }


PLACED = "array<struct<h:bigint,i:int>>"


def _placed(windows: Column) -> Column:
    """Windows' hashes with their places, equal ones side by side; none where all windows differ."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed).otherwise(F.array().cast(PLACED))


def _repeat_words(placed: Column) -> Column:
    """Words that lie in a three-word window found twice or more."""
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    before = F.concat(none, F.slice(placed, 1, F.greatest(F.size(placed) - 1, F.lit(0))))
    after = F.concat(F.slice(placed, 2, F.size(placed)), none)
    zipped = F.arrays_zip(placed.alias("x"), before.alias("y"), after.alias("z"))
    twice = F.filter(zipped, lambda t: (t["x"]["h"] == t["y"]["h"]) | (t["x"]["h"] == t["z"]["h"]))
    spots = F.flatten(F.transform(twice, lambda t: F.array(t["x"]["i"], t["x"]["i"] + 1, t["x"]["i"] + 2)))
    return F.size(F.array_distinct(spots))


def ledger(docs: DataFrame, row: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_bullet_lines, n_ellipsis_lines, n_letter_words,
    n_stop_words (different ones) and failed, the bits of the failed rules.

    A null text has no words and no lines; an empty one neither. Repeated rows give repeated results; other columns are not
    read. Windows are compared by 64-bit hashes of their words within one text. With row the column row holds all columns of docs.
    """
    carried = ["row"] if row else []
    whole = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if row else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *whole)
    rows = rows.select("doc_id", "text", *carried, *(c.alias(n) for n, c in measures(F.col("text")).items()))
    n = F.size("words")
    triples = F.transform(
        F.arrays_zip(F.col("words").alias("x"), F.slice("words", 2, F.greatest(n - 1, F.lit(0))).alias("y"), F.slice("words", 3, F.greatest(n - 2, F.lit(0))).alias("z")),
        lambda t: F.xxhash64(t["x"], t["y"], t["z"]),
    )
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: F.substring(F.btrim(x, F.lit(common.SPACE)), 1, 1).isin(*BULLETS))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: F.endswith(F.btrim(x, F.lit(common.SPACE)), F.lit("...")) | F.endswith(F.btrim(x, F.lit(common.SPACE)), F.lit("…")))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size(F.array_distinct(F.filter(F.transform(F.filter("words", lambda w: F.length(w) <= 4), F.lower), lambda w: w.isin(*STOP_WORDS)))).cast("long").alias("n_stop_words"),
        *carried,
        F.slice(triples, 1, F.greatest(n - 2, F.lit(0))).alias("windows"),
    )
    rows = rows.withColumn("placed", _placed(F.col("windows"))).drop("windows")
    rows = rows.withColumn("n_repeat_words", _repeat_words(F.col("placed")).cast("long")).drop("placed")
    bits = [F.when(F.expr(condition), F.lit(BITS[name])).otherwise(F.lit(0)) for name, condition in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed)


def fails(policy: Policy, failed: Column | str = "failed") -> Column:
    return F.expr(f"{failed} & {policy.mask}") != 0 if isinstance(failed, str) else failed.bitwiseAND(F.lit(policy.mask)) != 0


def ablation(rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """By rule of a policy: rows that fail it, and rows that this rule alone rejects, from the bits alone."""
    held = F.col("failed").bitwiseAND(F.lit(policy.mask))
    sums = rows.agg(*(F.count(F.when(held.bitwiseAND(F.lit(BITS[r])) != 0, 1)).alias(f"all_{r}") for r in policy.rules), *(F.count(F.when(held == BITS[r], 1)).alias(f"only_{r}") for r in policy.rules))
    each = F.array(*(F.struct(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), F.lit(r).alias("rule"), F.col(f"all_{r}").alias("n_failed"), F.col(f"only_{r}").alias("n_only")) for r in policy.rules))
    return sums.select(F.inline(each))


def judge(docs: DataFrame, policy: Policy = DEFAULT, row: bool = False) -> DataFrame:
    """The ledger, base_failed, kept (the verdict of the policy where the base rules hold) and only_rule, the rule of the policy without which the document would stay."""
    rows = ledger(docs, row).withColumn("base_failed", fails(BASE))
    held = F.col("failed").bitwiseAND(F.lit(policy.mask))
    only = F.create_map(*(F.lit(x) for r in policy.rules for x in (BITS[r], r)))
    return rows.withColumn("kept", ~F.col("base_failed") & ~fails(policy)).withColumn("only_rule", F.try_element_at(only, held))


def op4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, i, w FROM (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d))),
g AS (SELECT r, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w1, w2) > 1 AS twice FROM g),
c AS (SELECT r, max(twice::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM k),
rep AS (SELECT r, sum(hit) AS n FROM c GROUP BY r),
cw AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (WHERE regexp_matches(w, '\p{L}')) AS n_letter, count(DISTINCT lower(w)) FILTER (WHERE lower(w) IN ('the', 'be', 'to', 'of', 'and', 'that', 'have', 'with')) AS n_stop FROM w GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup, count(*) FILTER (WHERE left(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) IN ('-', '*', '•', '‣', '▪')) AS bullets,
  count(*) FILTER (WHERE regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS ellipses FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  coalesce(bullets, 0)::BIGINT AS n_bullet_lines, coalesce(ellipses, 0)::BIGINT AS n_ellipsis_lines, coalesce(n_letter, 0)::BIGINT AS n_letter_words, coalesce(n_stop, 0)::BIGINT AS n_stop_words
  FROM d LEFT JOIN cw USING (r) LEFT JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
  + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END + CASE WHEN n_words > 200000 THEN 32 ELSE 0 END + CASE WHEN 10 * n_bullet_lines > 9 * n_lines THEN 64 ELSE 0 END
  + CASE WHEN 10 * n_ellipsis_lines > 3 * n_lines THEN 128 ELSE 0 END + CASE WHEN 10 * n_letter_words < 8 * n_words THEN 256 ELSE 0 END + CASE WHEN n_stop_words < 2 THEN 512 ELSE 0 END)::INT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_bullet_lines, n_ellipsis_lines, n_letter_words, n_stop_words, n_repeat_words, failed, (failed & 3) <> 0 AS base_failed, (failed & 479) = 0 AS kept,
  CASE failed & 479 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines' WHEN 16 THEN 'word_length' WHEN 64 THEN 'bullets' WHEN 128 THEN 'ellipses' WHEN 256 THEN 'few_letters' END AS only_rule FROM b
"""
