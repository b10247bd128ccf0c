"""Statistics of variants, samples and cohorts over calls."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import variant as V
from . import overlap


def _allele_count(gt: Column, allele: str) -> Column:
    return F.size(F.filter(V.alleles(gt), lambda a: a == allele))


def cohort_stats(calls: DataFrame, members: DataFrame) -> DataFrame:
    """Allele and genotype counts by variant and cohort; a member without a call counts as 0/0."""
    sizes = F.broadcast(members.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_samples")))  # a row a cohort
    named = calls.join(members, "sample")
    counted = named.groupBy("key", "cohort").agg(
        F.count(F.lit(1)).alias("n_calls"),
        F.sum(_allele_count(F.col("gt"), "1")).cast("long").alias("alt"),
        F.sum(F.size(F.filter(V.alleles(F.col("gt")), lambda a: ~a.isin("0", ".")))).cast("long").alias("non_ref"),
        F.count(F.when(V.genotype_class(F.col("gt")) == "HOM_REF", 1)).alias("called_hom_ref"),
        F.count(F.when(V.genotype_class(F.col("gt")) == "HET_REF", 1)).alias("het"),
        F.count(F.when(V.genotype_class(F.col("gt")) == "HOM_ALT", 1)).alias("hom_alt"),
        F.count(F.when(F.array_contains("filter", "PASS"), 1)).alias("n_pass"),
    )
    out = counted.join(sizes, "cohort").withColumn("alleles", 2 * F.col("n_samples")).withColumn("hom_ref", F.col("called_hom_ref") + F.col("n_samples") - F.col("n_calls"))
    out = out.withColumn("alt_freq", F.col("alt") / F.col("alleles")).withColumn("ref_freq", 1 - F.col("non_ref") / F.col("alleles"))
    out = out.withColumn("maf", F.least("alt_freq", "ref_freq")).withColumn("mgf", F.least("hom_ref", "het", "hom_alt") / F.col("n_samples")).withColumn("pass_freq", F.col("n_pass") / F.col("n_calls"))
    return out.drop("called_hom_ref")


def filter_counts(calls: DataFrame, members: DataFrame) -> DataFrame:
    """By variant and cohort: calls of each FILTER value, and the mean quality."""
    named = calls.join(F.broadcast(members), "sample")  # a row a sample
    quality = named.groupBy("key", "cohort").agg(F.avg("qual").alias("mean_qual"))
    return named.select("key", "cohort", F.explode("filter").alias("value")).groupBy("key", "cohort", "value").agg(F.count(F.lit(1)).alias("n")).join(quality, ["key", "cohort"])


def frequencies_from_counts(n_samples: Column, alt: Column, non_ref: Column, missing: Column) -> tuple[Column, Column, Column]:
    """Alternate, reference and minor frequencies from counts of alleles; missing ones do not count."""
    total = 2 * n_samples - missing
    alt_freq = F.coalesce(F.try_divide(alt, total), F.lit(0.0))
    ref_freq = 1 - F.coalesce(F.try_divide(non_ref, total), F.lit(0.0))
    return alt_freq, ref_freq, F.least(alt_freq, ref_freq)


def transmission(trios: DataFrame) -> DataFrame:
    """Transmission disequilibrium by variant: how often heterozygous parents hand the alternate down or not, and chi square."""
    het = lambda c: V.genotype_class(F.col(c)) == "HET_REF"
    child = _allele_count(F.col("child"), "1")
    other = lambda c: F.when(V.genotype_class(F.col(c)) == "HOM_ALT", 1).otherwise(0)
    parents = het("father").cast("int") + het("mother").cast("int")
    # What a homozygous parent gives is known; the rest of the child's alternates comes from heterozygous ones.
    given = F.greatest(F.least(child - F.when(~het("father"), other("father")).otherwise(0) - F.when(~het("mother"), other("mother")).otherwise(0), parents), F.lit(0))
    sums = trios.filter(parents > 0).groupBy("key").agg(F.sum(given).cast("long").alias("given"), F.sum(parents - given).cast("long").alias("kept"))
    return sums.withColumn("chi_square", (F.col("given") - F.col("kept")) * (F.col("given") - F.col("kept")) / (F.col("given") + F.col("kept")).cast("double"))


def sample_stats(calls: DataFrame, variants: DataFrame) -> DataFrame:
    """One row a sample: variants, heterozygosity, transitions by transversions, mean depth."""
    carried = calls.filter(V.genotype_class(F.col("gt")) != "HOM_REF").join(variants.select("key", "reference", "alternate", "type"), "key")
    r, a = F.col("reference"), F.col("alternate")
    out = carried.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(V.genotype_class(F.col("gt")).isin("HET_REF", "HET_ALT"), 1)).alias("het"),
        F.count(F.when(V.is_transition(r, a), 1)).alias("ti"),
        F.count(F.when(V.is_transversion(r, a), 1)).alias("tv"),
        F.sum("dp").cast("long").alias("depth"),
    )
    return out.withColumn("het_rate", F.col("het") / F.col("n")).withColumn("ti_tv", F.try_divide(F.col("ti").cast("double"), F.col("tv").cast("double")))


def sample_dimension(calls: DataFrame, variants: DataFrame, dimension: str) -> DataFrame:
    """Counts by sample and chrom, type, genotype or depth class."""
    value = {
        "chrom": F.col("chrom"),
        "type": F.col("type"),
        "genotype": V.unphased(F.col("gt")),
        "depth": F.when(F.col("dp") < 5, "<5").when(F.col("dp") < 10, "5-10").when(F.col("dp") < 15, "10-15").when(F.col("dp") < 20, "15-20").otherwise(">=20"),
    }[dimension]
    return calls.join(variants, "key").groupBy("sample", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def saturation(calls: DataFrame, batch: int) -> DataFrame:
    """By batch of samples: variants seen in it, variants new in it, and variants seen up to it."""
    carried = calls.filter(V.carries(F.col("gt"))).select("key", F.floor(F.col("sample") / batch).alias("batch"))
    seen = carried.groupBy("batch").agg(F.countDistinct("key").alias("seen"))
    new = carried.groupBy("key").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count(F.lit(1)).alias("new"))
    rows = seen.join(new, "batch", "left").select("batch", "seen", F.coalesce("new", F.lit(0)).cast("long").alias("new"))
    return rows.withColumn("total", F.sum("new").over(W.orderBy("batch")))  # a row a batch


def histogram(variants: DataFrame, step: int) -> DataFrame:
    return variants.groupBy("chrom", (F.floor(F.col("start") / step) * step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def population_frequencies(stats: DataFrame) -> DataFrame:
    """Cohorts in which a variant occurs, as one sorted list of cohort and alternate count."""
    return stats.filter("alt > 0").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("cohort", "alt"))).alias("found"))


def mismatches(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows of two tables that differ, or that one of them lacks."""
    both = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in columns), F.lit(True).alias("in_a")).join(b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in columns), F.lit(True).alias("in_b")), keys, "full")
    differ = V.any_of([~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in columns])
    return both.filter(F.col("in_a").isNull() | F.col("in_b").isNull() | differ)


def allele_tables(calls: DataFrame, cases: Column, everyone: int, n_cases: int) -> DataFrame:
    """Reference and alternate alleles of cases and controls by variant; samples without a call are 0/0; all-zero rows go."""
    is_case = cases
    out = calls.groupBy("key").agg(F.sum(F.when(is_case, _allele_count(F.col("gt"), "1")).otherwise(0)).cast("long").alias("case_alt"), F.sum(F.when(is_case, 0).otherwise(_allele_count(F.col("gt"), "1"))).cast("long").alias("control_alt"))
    out = out.withColumn("case_ref", F.lit(2 * n_cases) - F.col("case_alt")).withColumn("control_ref", F.lit(2 * (everyone - n_cases)) - F.col("control_alt")).filter("case_alt + control_alt > 0")
    return out.withColumn("odds_ratio", F.try_divide(F.col("case_ref").cast("double") * F.col("control_alt"), F.col("control_ref").cast("double") * F.col("case_alt")))


def log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series at k + 8, where it is exact to double precision, less the factors in between."""
    n = k.cast("double") + 8
    series = n * F.log(n) - n + 0.5 * F.log(2 * math.pi * n) + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5) - 1 / (1680 * n**7)
    between = F.lit(1.0)
    for i in range(1, 9):
        between = between * (k.cast("double") + i)
    return series - F.log(between)


def fisher(table: DataFrame) -> DataFrame:
    """Two-sided p-values of Fisher's exact test on case_ref, control_ref, case_alt, control_alt.

    The margins of a table recur in most rows, so the test runs once for each distinct table, as a sum of hypergeometric
    terms over the possible counts, in built-in functions.
    """
    names = ["case_ref", "control_ref", "case_alt", "control_alt"]
    a, b, c, d = (F.col(n) for n in names)
    n, row, col = a + b + c + d, a + b, a + c
    distinct = table.select(*names).distinct().withColumns({"fixed": log_factorial(row) + log_factorial(n - row) + log_factorial(col) + log_factorial(n - col) - log_factorial(n), "low": F.greatest(F.lit(0), row + col - n), "high": F.least(row, col)})
    term = lambda k: F.col("fixed") - log_factorial(k) - log_factorial(row - k) - log_factorial(col - k) - log_factorial(n - row - col + k)
    distinct = distinct.withColumns({"here": term(a), "terms": F.transform(F.sequence("low", "high"), term)})
    p = F.aggregate(F.filter("terms", lambda t: t <= F.col("here") + 1e-7), F.lit(0.0), lambda x, t: x + F.exp(t))
    return table.join(distinct.select(*names, F.least(p, F.lit(1.0)).alias("p_value")), names)


def coverage_levels(depth: DataFrame, regions: DataFrame, levels: tuple[int, ...]) -> DataFrame:
    """By region: positions, mean, least and greatest depth, and the share of positions at each level, in percent."""
    at = depth.select("chrom", F.col("pos").alias("start"), F.col("pos").alias("end"), "depth")
    inside = overlap.overlaps(at, regions.select(F.col("r_chrom").alias("chrom"), F.col("r_start").alias("start"), F.col("r_end").alias("end"))).withColumnRenamed("chrom", "r_chrom")
    size = F.col("r_end") - F.col("r_start") + 1
    out = inside.groupBy("r_chrom", "r_start", "r_end").agg(
        F.count(F.lit(1)).alias("n_pos"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.sum("depth").cast("long").alias("total"), *(F.count(F.when(F.col("depth") >= k, 1)).alias(f"at_{k}") for k in levels)
    )
    return out.withColumn("mean_depth", F.col("total") / size).withColumns({f"at_{k}": 100.0 * F.col(f"at_{k}") / size for k in levels})


def log2_ratio(a: DataFrame, b: DataFrame, window: int) -> DataFrame:
    """By window: the logarithm of the depths' ratio, each divided by its total."""
    fold = lambda df, n: df.groupBy("chrom", F.floor(F.col("pos") / window).alias("window")).agg(F.sum("depth").cast("long").alias(n))
    x, y = fold(a, "x"), fold(b, "y")
    tx, ty = a.agg(F.sum("depth").alias("tx")), b.agg(F.sum("depth").alias("ty"))
    both = x.join(y, ["chrom", "window"]).crossJoin(F.broadcast(tx)).crossJoin(F.broadcast(ty))  # one row each
    return both.select("chrom", "window", "x", "y", F.log2((F.col("x") / F.col("tx")) / (F.col("y") / F.col("ty"))).alias("log2_ratio"))
