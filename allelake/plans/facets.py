"""Facets as grouped aggregations: one plan for each facet, parents by grouping sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variant as V
from . import language as L

#: Bounds of length classes, and the step of a density facet.
LENGTHS = (1, 5, 10, 20, 50)
DENSITY_STEP = 1_000_000


def range_label(value: Column, bounds: list[float], upper_closed: bool = False) -> Column:
    """The range that a value lies in, open ended on both sides; 'NA' for a missing one. Upper bounds belong to a range only if closed."""
    out = F.when(value.isNull(), "NA")
    show = lambda x: f"{x:g}"
    for i, b in enumerate(bounds):
        inside = value <= b if upper_closed else value < b
        label = f"(-inf, {show(b)}" if i == 0 else f"{'(' if upper_closed else '['}{show(bounds[i - 1])}, {show(b)}"
        out = out.when(inside, label + ("]" if upper_closed else ")"))
    return out.otherwise(f"{'(' if upper_closed else '['}{show(bounds[-1])}, inf)")


def length_class(length: Column) -> Column:
    out = F.when(length < LENGTHS[0], f"<{LENGTHS[0]}")
    for a, b in zip(LENGTHS, LENGTHS[1:]):
        out = out.when(length < b, f"[{a}, {b})")
    return out.otherwise(f"[{LENGTHS[-1]}, inf)")


#: Fields: how a row's value, or its array of values, is found.
FIELDS = {
    "chromosome": (lambda: F.col("chrom"), False),
    "type": (lambda: F.col("type"), False),
    "release": (lambda: F.col("release").cast("string"), False),
    "study": (lambda: F.col("study"), False),
    "length": (lambda: length_class(F.col("end") - F.col("start") + 1), False),
    "gene": (lambda: F.col("cts.gene"), True),
    "biotype": (lambda: F.col("cts.biotype"), True),
    "consequenceType": (lambda: F.col("cts.term"), True),
    "transcriptFlag": (lambda: F.col("cts.flag"), True),
    "clinicalSignificance": (lambda: F.col("evidence.significance"), True),
    "genotype": (lambda: F.transform("calls.gt", V.unphased), True),
    "sample": (lambda: F.transform("calls.sample", lambda x: x.cast("string")), True),
}
NUMBERS = {"start": "start", "cadd_scaled": "cadd", "popFreq": "freq", "phastCons": "phastcons"}
FUNCTIONS = {
    "avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "stddev": F.stddev, "count": F.count, "unique": F.countDistinct,
    "percentile": lambda c: F.percentile(c, F.lit(0.5)),
}


LOOKS_INTO = {"cts": ("gene", "biotype", "consequenceType", "transcriptFlag"), "evidence": ("clinicalSignificance",), "calls": ("genotype", "sample")}


def parts(levels: list[L.Facet]) -> tuple[str, ...]:
    """The nested arrays that a facet needs."""
    return tuple(p for p, names in LOOKS_INTO.items() if any(x.name in names for x in levels))


def _value(level: L.Facet) -> tuple[Column, bool]:
    if level.name in NUMBERS:
        c = F.col(NUMBERS[level.name])
        if level.step is None:
            raise L.LanguageError(f"a number needs a range: {level.name}")
        inside = (c >= level.low) & (c < level.high)
        return F.when(inside, (F.lit(level.low) + F.floor((c - level.low) / level.step) * level.step).cast("string")), False
    if level.name == "chromDensity":
        return F.concat_ws(":", "chrom", (F.floor(F.col("start") / (level.limit or DENSITY_STEP)) * (level.limit or DENSITY_STEP)).cast("string")), False
    if level.name not in FIELDS:
        raise L.LanguageError(f"no facet field {level.name!r}")
    make, many = FIELDS[level.name]
    return make(), many


def facet(rows: DataFrame, levels: list[L.Facet]) -> DataFrame:
    """Columns level_1.. and n: rows of each bucket and of the buckets above it (whose lower levels are null).

    A row counts once in a bucket, and a bucket's parent counts rows, not values; values listed in brackets are the
    only ones kept; missing values form the bucket 'other'. A last level with a function adds its value instead of a level.
    """
    *outer, last = levels
    if last.function is None:
        outer = levels
    names = [f"level_{i + 1}" for i in range(len(outer))]
    measure = [] if last.function is None else [FUNCTIONS[last.function](F.col(NUMBERS.get(last.name, last.name))).cast("double").alias("value")]
    for name, level in zip(names, outer):
        value, many = _value(level)
        if many:
            held = F.array_distinct(value)
            rows = rows.withColumn(name, F.explode(F.when(F.size(held) > 0, held).otherwise(F.array(F.lit("other")))))
        elif level.step is not None:
            rows = rows.withColumn(name, value).filter(F.col(name).isNotNull())
        else:
            rows = rows.withColumn(name, F.coalesce(value, F.lit("other")))
        if level.include:
            rows = rows.filter(F.col(name).isin(*level.include))
    multi = any(_value(x)[1] for x in outer[1:])
    count = F.countDistinct("key") if multi else F.count(F.lit(1))
    if not names:
        return rows.agg(count.cast("long").alias("n"), *measure)
    grouped = rows.rollup(*names).agg(F.grouping_id().alias("g"), count.cast("long").alias("n"), *measure)
    return grouped.filter(F.col("g") < 2 ** len(names) - 1).drop("g")


def facets(rows: DataFrame, text: str) -> dict[str, DataFrame]:
    return {part: facet(rows, levels) for part, levels in zip(L.split(text, L.AND), L.facets(text))}


def included_zeros(buckets: DataFrame, include: list[str]) -> DataFrame:
    """Buckets of one level, with those asked for that no row has, as zeros."""
    asked = buckets.sparkSession.createDataFrame([(v,) for v in include], "level_1 string")
    return asked.join(buckets, "level_1", "left").select("level_1", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def density(rows: DataFrame, chrom: str, start: int, end: int, step: int) -> DataFrame:
    """Variants by steps of a region, empty steps as zeros, and the natural logarithm of the counts."""
    bins = rows.sparkSession.range(0, (end - start) // step + 1).select((F.lit(start) + F.col("id") * step).alias("bin"))
    inside = rows.filter((F.col("chrom") == chrom) & F.col("start").between(start, end))
    counts = inside.groupBy((F.lit(start) + F.floor((F.col("start") - start) / step) * step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n")).withColumn("log_n", F.when(F.col("n") > 0, F.log("n")).otherwise(0.0))


def ratio(rows: DataFrame, over: Column, under: Column, *by: str) -> DataFrame:
    """Rows that satisfy one condition by those that satisfy another."""
    out = rows.groupBy(*by).agg(F.count(F.when(over, 1)).alias("over"), F.count(F.when(under, 1)).alias("under"))
    return out.withColumn("ratio", F.try_divide(F.col("over").cast("double"), F.col("under").cast("double")))


def rank(rows: DataFrame, field: Column, n: int, ascending: bool = False) -> DataFrame:
    """The n values with the most distinct variants; ties in order of the values."""
    counted = rows.select("key", field.alias("value")).groupBy("value").agg(F.countDistinct("key").alias("n"))
    return counted.orderBy(F.asc("n") if ascending else F.desc("n"), "value").limit(n)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
