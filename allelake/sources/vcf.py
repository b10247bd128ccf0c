"""VCF as DataFrames: reading lines into records, writing records as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variant as V


def records(lines: DataFrame, keep_malformed: bool = False) -> DataFrame:
    """Lines (column value) as chrom, pos, id, reference, alternates, qual, filter, info, format, sample_values.

    Header lines are left out. A line with fewer than eight fields or a position that is no number is malformed: it is left
    out, or with keep_malformed alone returned.
    """
    body = lines.filter(~F.startswith("value", F.lit("#")) & (F.length("value") > 0))
    f = F.split("value", "\t")
    pos = F.get(f, 1).try_cast("long")
    bad = (F.size(f) < 8) | pos.isNull()
    if keep_malformed:
        return body.filter(bad)
    dot = lambda c: F.when(c != ".", c)
    return body.filter(~bad).select(
        V.clean_chromosome(f[0]).alias("chrom"), pos.alias("pos"), dot(f[2]).alias("id"), f[3].alias("reference"), F.split(f[4], ",").alias("alternates"), dot(f[5]).try_cast("double").alias("qual"),
        F.split(dot(f[6]), "[;,]").alias("filter"), info(f[7]).alias("info"), F.split(F.get(f, 8), ":").alias("format"), F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))).alias("sample_values"),
    )


def info(text: Column) -> Column:
    """'A=1;B' as a map; a key without a value is true."""
    pairs = F.transform(F.filter(F.split(text, ";"), lambda x: (x != ".") & (x != "")), lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.coalesce(F.get(F.split(x, "=", 2), 1), F.lit("true")).alias("v")))
    return F.map_from_entries(pairs)


def biallelic(rows: DataFrame) -> DataFrame:
    """One row an alternate, its alleles without what they share; alternate_index counts from 1."""
    each = rows.select("*", F.posexplode("alternates").alias("k", "alternate")).drop("alternates")
    cut = V.trimmed(F.col("pos"), F.col("reference"), F.col("alternate"))
    return each.withColumn("t", cut).select(F.col("t.start").alias("start"), F.col("t.reference").alias("reference"), F.col("t.alternate").alias("alternate"), (F.col("k") + 1).alias("alternate_index"), *(c for c in each.columns if c not in ("pos", "reference", "alternate", "k")))


def calls(rows: DataFrame, samples: list[str]) -> DataFrame:
    """One row a record and sample, with the FORMAT fields as a map."""
    named = F.arrays_zip(F.array(*map(F.lit, samples)).alias("sample"), F.col("sample_values").alias("text"))
    each = rows.select(*(c for c in rows.columns if c not in ("sample_values",)), F.explode(named).alias("s")).filter("s.text IS NOT NULL")
    values = F.split("s.text", ":")
    n = F.least(F.size("format"), F.size(values))
    return each.select(*(c for c in each.columns if c != "s"), F.col("s.sample").alias("sample"), F.map_from_arrays(F.slice("format", 1, n), F.slice(values, 1, n)).alias("data"))


def _by_sample(calls: DataFrame, samples: list[int], missing: str) -> Column:
    """Genotypes in the order of the samples, from the column gts."""
    order = F.array(*(F.lit(s).cast("long") for s in samples))
    return F.transform(order, lambda s: F.coalesce(F.try_element_at("gts", s), F.lit(missing)))


def lines(variants: DataFrame, calls: DataFrame, samples: list[int], missing: str = "./.") -> DataFrame:
    """A VCF line (column line) for each variant, with a genotype column for each sample."""
    gts = calls.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("sample", "gt"))).alias("gts"))
    rows = variants.join(gts, "key", "left")
    note = F.concat_ws(";", F.concat(F.lit("END="), F.col("end").cast("string")), F.concat(F.lit("TYPE="), F.col("type")))
    gt = F.array_join(_by_sample(calls, samples, missing), "\t")
    return rows.select("key", F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.coalesce("rs", F.lit(".")), "reference", "alternate", F.lit("."), F.lit("PASS"), note, F.lit("GT"), gt).alias("line"))


def tped(variants: DataFrame, calls: DataFrame, samples: list[int]) -> DataFrame:
    """A transposed-PED line for each variant: chrom, id, 0, start and two alleles a sample, 0 where unknown."""
    gts = calls.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("sample", "gt"))).alias("gts"))
    rows = variants.join(gts, "key", "left")
    base = lambda x: F.when(x == "0", F.col("reference")).when(x == "1", F.col("alternate")).otherwise("0")

    def pair(gt: Column) -> Column:
        a = V.alleles(gt)
        return F.coalesce(F.concat(base(F.get(a, 0)), F.lit(" "), base(F.get(a, 1))), F.lit("0 0"))

    pairs = F.array_join(F.transform(_by_sample(calls, samples, "."), pair), " ")
    return rows.select("key", F.concat_ws(" ", "chrom", V.variant_id(), F.lit("0"), F.col("start").cast("string"), pairs).alias("line"))


def tfam(trios: DataFrame) -> DataFrame:
    """Family lines: family, individual, father, mother, sex (1 male, 2 female, 0 unknown), phenotype -9; one a member."""
    who = lambda s, f, m, sex: F.struct(F.col(s).cast("string").alias("id"), f.alias("father"), m.alias("mother"), F.lit(sex).alias("sex"))
    none, text = F.lit("0"), lambda c: F.col(c).cast("string")
    people = F.array(who("child", text("father"), text("mother"), "0"), who("father", none, none, "1"), who("mother", none, none, "2"))
    return trios.select("trio", F.explode(people).alias("p")).select(F.concat_ws(" ", "trio", "p.id", "p.father", "p.mother", "p.sex", F.lit("-9")).alias("line"))


def effect_input(variants: DataFrame) -> DataFrame:
    """Lines of the default input of effect predictors: chrom, first and last base, alleles, strand; an insertion's last base is the one before it."""
    r, a = F.col("reference"), F.col("alternate")
    show = lambda c: F.when(c == "", "-").otherwise(c)
    return variants.select("key", F.concat_ws(" ", "chrom", F.col("start").cast("string"), (F.col("start") + F.length(r) - 1).cast("string"), F.concat(show(r), F.lit("/"), show(a)), F.lit("+")).alias("line"))
