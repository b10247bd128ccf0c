"""Tracks and scores in tab-separated text, and plain table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overlap

#: Columns of the track formats.
COLUMNS = {
    "bed": "chrom string, start long, end long, name string, score string, strand string",
    "gff": "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attribute string",
}


def track(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A BED or GFF file with closed, one-based intervals; other kinds are an error."""
    kind = kind or path.removesuffix(".gz").rpartition(".")[2].lower()
    if kind not in COLUMNS:
        raise ValueError(f"no track format: {kind!r}")
    rows = spark.read.csv(path, sep="\t", comment="#", schema=COLUMNS[kind], mode="DROPMALFORMED")
    return rows.withColumn("start", F.col("start") + 1) if kind == "bed" else rows


def annotate(variants: DataFrame, features: DataFrame, value: str) -> DataFrame:
    """Of each variant the values of the features over it, sorted, as one text; null without any."""
    hits = overlap.overlaps(variants.select("key", "chrom", "start", "end"), features)
    found = hits.groupBy("key").agg(F.array_join(F.sort_array(F.collect_set(f"r_{value}")), ",").alias("features"))
    return variants.join(found, "key", "left")


def scores(spark: SparkSession, path: str, columns: dict[str, int]) -> DataFrame:
    """Scores by column index: id, or chrom, start, reference, alternate; score and perhaps p_value."""
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("f"))
    return rows.select(*((F.col("f")[i].try_cast("double") if n in ("score", "p_value") else F.col("f")[i]).alias(n) for n, i in columns.items()))


def write(rows: DataFrame, path: str, kind: str) -> None:
    """Parquet, JSON or tab-separated text, by Spark's own writers."""
    w = rows.write.mode("overwrite")
    {"parquet": w.parquet, "json": w.json, "tsv": lambda p: w.csv(p, sep="\t", header=True)}[kind](path)
