"""Records of files and versions: duplicates, gaps, mates, merges, upserts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import variant as V
from . import overlap


def best_duplicate(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first by order."""
    ranked = rows.withColumn("rank_", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("rank_ = 1").drop("rank_")


def without_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once."""
    once = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).filter("n_ = 1").drop("n_")
    return rows.join(once, keys, "left_semi")


def mates(rows: DataFrame, window: int) -> DataFrame:
    """Breakends with their mates: rows have id, mate, chrom, start, mate_chrom, mate_start; each pair once, in locus order."""
    a = rows.alias("a")
    b = rows.select(*(F.col(c).alias(f"b_{c}") for c in rows.columns)).alias("b")
    pairs = a.join(b, (F.col("mate") == F.col("b_id")) & (F.col("b_mate") == F.col("id")) & (F.col("b_chrom") == F.col("mate_chrom")) & (F.abs(F.col("b_start") - F.col("mate_start")) <= window))
    first = F.struct(V.chrom_order("chrom"), "start", "id") < F.struct(V.chrom_order("b_chrom"), "b_start", "b_id")
    return pairs.filter(first).select("id", F.col("b_id").alias("mate_id"), "chrom", "start", F.col("b_chrom").alias("mate_chrom"), F.col("b_start").alias("mate_start"))


def remapped(gt):
    """A genotype of another variant, seen from this one: its alternate becomes the second."""
    return F.when(gt.isNull(), None).otherwise(F.regexp_replace(F.regexp_replace(gt, "[2-9]", "."), "1", "2"))


def fill_gaps(variants: DataFrame, samples: DataFrame, calls: DataFrame, archive: DataFrame, gap: str = "./.") -> DataFrame:
    """Statuses of the samples that a variant has no call of: key, sample, status, gt.

    archive has sample, chrom, start, end, is_reference, gt: what each sample's file says. Without an overlap the status is
    GAP; several other variants are MULTI; a reference block is REFERENCE with its genotype; one other variant is VARIANT
    with the remapped genotype.
    """
    # The list of samples is one row.
    every = F.broadcast(samples.agg(F.collect_list("sample").alias("every")))
    called = calls.groupBy("key").agg(F.collect_set("sample").alias("called"))
    rows = variants.select("key", "chrom", "start", "end").join(called, "key", "left").crossJoin(every)
    rows = rows.withColumn("missing", F.when(F.col("called").isNull(), F.col("every")).otherwise(F.array_except("every", "called"))).drop("called", "every")
    # Nearly all variants lie in one bin, where they are done with; of the others the bins' counts are added up.
    within = F.coalesce(F.col("chrom").isNotNull() & (F.floor(F.col("start") / overlap.BIN) >= F.floor(F.col("end") / overlap.BIN)), F.lit(False))
    across = rows.filter(~within)
    found = overlap.tallies(across, archive).groupBy("key", "sample").agg(F.sum("n_other").alias("n_other"), F.min("other").alias("other"), F.min("ref").alias("ref"))
    out = across.select("key", F.explode("missing").alias("sample")).join(found, ["key", "sample"], "left").unionByName(overlap.tallies(rows.filter(within), archive))
    status = F.when(F.coalesce("n_other", F.lit(0)) > 1, "MULTI").when(F.col("n_other") == 1, "VARIANT").when(F.col("ref").isNotNull(), "REFERENCE").otherwise("GAP")
    gt = F.when(status == "MULTI", "2/2").when(status == "VARIANT", remapped(F.col("other"))).when(status == "REFERENCE", F.col("ref")).otherwise(gap)
    return out.select("key", "sample", status.alias("status"), gt.alias("gt"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with changed rows in place of those with their keys."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last version of each key."""
    return best_duplicate(rows, keys, [F.desc(version)])


def out_of_sync(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one side alone, and which: missing in a, or in b."""
    # One grouping of both sides: keys are folded before the shuffle, and no side is sorted to meet the other.
    side = lambda df, of: df.select(*keys, F.lit(of == "a").alias("in_a_"), F.lit(of == "b").alias("in_b_"))
    held = side(a, "a").unionByName(side(b, "b")).groupBy(*keys).agg(F.max("in_a_").alias("in_a_"), F.max("in_b_").alias("in_b_"))
    # A key with a null equals none, so either side lacks it.
    alone = lambda here, there: F.col(here) & (~F.col(there) | reduce(or_, (F.col(k).isNull() for k in keys)))
    lacking = F.array_compact(F.array(F.when(alone("in_a_", "in_b_"), "b"), F.when(alone("in_b_", "in_a_"), "a")))
    return held.select(*keys, F.explode(lacking).alias("missing_in"))


def merge_files(calls: DataFrame) -> DataFrame:
    """Variants over files: how many files and samples hold each, with the files as one sorted text."""
    return calls.groupBy("key").agg(F.countDistinct("file").alias("n_files"), F.count(F.lit(1)).alias("n_calls"), F.array_join(F.sort_array(F.collect_set("file")), ",").alias("files"))


def phased_near(rows: DataFrame, window: int) -> DataFrame:
    """Of each phased call, how many other phased calls of its sample, chrom and phase set start within window positions."""
    return overlap.nearby(rows.filter("ps IS NOT NULL"), window, "sample", "chrom", "ps").withColumnRenamed("n_near", "n_phased")


def prunable(stats: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants that no cohort's files hold."""
    return variants.join(stats.filter("n_calls > 0").select("key").distinct(), "key", "left_anti")


def merge_alleles(rows: DataFrame) -> DataFrame:
    """Calls of files that name different alternates at one locus, with one list of alternates a locus.

    rows: chrom, start, reference, alternate, sample, gt. Alternates are listed in order; an allele 1 becomes the place of
    its row's alternate in the list, any other alternate becomes '<*>', a place behind them.
    """
    locus = ["chrom", "start", "reference"]
    lists = rows.groupBy(*locus).agg(F.array_sort(F.collect_set("alternate")).alias("alternates"))
    both = rows.join(lists, locus)
    place = F.array_position("alternates", F.col("alternate")).cast("string")
    other = (F.size("alternates") + 1).cast("string")
    renamed = lambda a: F.when(a.isin("0", "."), a).when(a == "1", place).otherwise(other)
    sign = F.when(F.contains("gt", F.lit("|")), "|").otherwise("/")
    gt = F.when(F.size(F.split("gt", r"[/|]")) == 1, renamed(F.col("gt"))).otherwise(F.array_join(F.transform(F.split("gt", r"[/|]"), renamed), "/"))
    return both.select(*locus, "alternates", "sample", F.when(sign == "|", F.replace(gt, F.lit("/"), F.lit("|"))).otherwise(gt).alias("gt"))


def annotation_lines(lines: DataFrame, column: str) -> DataFrame:
    """id and phenotype of tab-separated lines; comments and lines that are no pair with a number go."""
    f = F.split(column, "\t")
    return lines.filter(~F.startswith(column, F.lit("#")) & (F.size(f) == 2)).select(F.get(f, 0).try_cast("long").alias("id"), F.get(f, 1).alias("phenotype")).filter("id IS NOT NULL")
