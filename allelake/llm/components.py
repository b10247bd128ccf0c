"""Connected components by alternating large-star and small-star steps, entirely as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import common

#: A key of more rows than this is split over several tasks; no more than HOT keys are, so the list of them is small.
SPLIT, HOT = 512, 10_000


def spread(rows: DataFrame, keys: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with keys, which has one row a key and in n how many rows there are of it; total: all rows.

    The rows of a key that has many go to several tasks, each with a copy of the key's row. Keys with more than total / HOT
    rows number HOT at most, which bounds what is broadcast.
    """
    most = max(SPLIT, -(-total // HOT))
    hot = keys.filter(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("_parts"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    right = keys.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > most, F.ceil(F.col("n") / most) - 1).otherwise(0).cast("int"))))
    return left.join(right, [key, "_part"]).drop("_part")


def components(edges: DataFrame) -> DataFrame:
    """The least id that each id of the edges (a, b) reaches: columns id, component.

    Ids without an edge are not listed; edges may repeat, in either direction. Each round is written to the shared
    folder; rounds end when the edges no longer change.
    """
    edges, now = _written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while seen != now:
        seen = now
        # Large star: larger neighbours of a node move to its least one.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        edges = spread(both, least, "a", 2 * now[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: smaller neighbours of a node, and itself, move to the least of them.
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = spread(edges, least, "a", 2 * now[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges, now = _written(moved.union(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct(), 2 * now[0])
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _written(edges: DataFrame, rows: int | None = None) -> tuple[DataFrame, tuple]:
    """The edges from a checkpoint, and what tells whether they have changed. rows: about how many there are at most."""
    found = Observation()
    edges = common.materialize(edges.observe(found, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")), rows)
    return edges, tuple(found.get.values())
