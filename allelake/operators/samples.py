"""Sets of samples and of variants: union, intersection, complement, division."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def all_of(sets: list[DataFrame], none_of: list[DataFrame] = (), key: str = "key") -> DataFrame:
    """Keys in every one of sets and in none of the others."""
    out = sets[0].select(key).distinct()
    for s in sets[1:]:
        out = out.join(s, key, "left_semi")
    for s in none_of:
        out = out.join(s, key, "left_anti")
    return out


def any_of(sets: list[DataFrame], key: str = "key") -> DataFrame:
    return reduce(DataFrame.union, [s.select(key) for s in sets]).distinct()


def in_all(pairs: DataFrame, wanted: DataFrame, member: str, key: str = "key") -> DataFrame:
    """Members that have every wanted key (division); wanted keys are counted once."""
    wanted = wanted.select(key).distinct()
    need = wanted.agg(F.count(F.lit(1)).alias("need"))
    have = pairs.join(wanted, key, "left_semi").groupBy(member).agg(F.countDistinct(key).alias("have"))
    return have.join(F.broadcast(need), have["have"] == need["need"]).select(member)  # need is one row


def eligible(tree, everyone: DataFrame, key: str = "sample") -> DataFrame:
    """Samples that a tree of ("and", ...), ("or", ...), ("not", x) and DataFrames selects. Double negation falls away."""
    if isinstance(tree, DataFrame):
        return tree.select(key).distinct()
    op, *parts = tree
    if op == "not":
        if not isinstance(parts[0], DataFrame) and parts[0][0] == "not":
            return eligible(parts[0][1], everyone, key)
        return everyone.select(key).distinct().join(eligible(parts[0], everyone, key), key, "left_anti")
    if op == "or":
        return any_of([eligible(p, everyone, key) for p in parts], key)
    plain = [p for p in parts if isinstance(p, DataFrame) or p[0] != "not"]
    rest = [p[1] for p in parts if not isinstance(p, DataFrame) and p[0] == "not"]
    start = [eligible(p, everyone, key) for p in plain] or [everyone]
    return all_of(start, [eligible(p, everyone, key) for p in rest], key)


#: Samples of one side of a tile, and calls that one task multiplies, about.
TILE, CALLS = 512, 1 << 20


def pair_counts(calls: DataFrame, tile: int = TILE, per_task: int = CALLS) -> DataFrame:
    """Of each pair of samples (a < b) the variants called in both (shared) and with equal genotypes (same).

    Calls form blocks of variants and pairs of sample tiles; a task multiplies incidence columns of one of these, so
    that what it sends grows with the pairs of samples and not with their variants. Columns: key, sample, gt.
    """
    rows = calls.select(F.xxhash64("key").alias("key"), F.col("sample").cast("long").alias("sample"), F.xxhash64("gt").alias("gt"), F.floor(F.col("sample") / tile).cast("int").alias("part"))
    n, tiles = rows.agg(F.count(F.lit(1)), F.max("part")).first()
    blocks, tiles = max(1, (n or 0) // per_task), (tiles or 0) + 1
    rows = rows.withColumn("block", F.pmod("key", F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    rows = rows.select("block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "key", "sample", "gt")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("same", pa.int64())])

    def multiply(table: pa.Table) -> pa.Table:
        samples, column = np.unique(table["sample"].to_numpy(), return_inverse=True)
        _, row = np.unique(table["key"].to_numpy(), return_inverse=True)
        kinds, kind = np.unique(table["gt"].to_numpy(), return_inverse=True)
        side = samples // tile
        shared, same = np.zeros((2, len(samples), len(samples)))
        step = max(1, (1 << 22) // max(len(samples), 1))
        order = np.argsort(row, kind="stable")
        row, column, kind = row[order], column[order], kind[order]
        for first in range(0, int(row[-1]) + 1 if len(row) else 0, step):
            a, b = np.searchsorted(row, (first, first + step))
            grid = np.zeros((step, len(samples)), np.float32)
            grid[row[a:b] - first, column[a:b]] = 1
            shared += grid.T @ grid
            for k in range(len(kinds)):
                here = np.zeros_like(grid)
                of = kind[a:b] == k
                here[row[a:b][of] - first, column[a:b][of]] = 1
                same += here.T @ here
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        keep = np.triu(shared > 0, 1) & ((side[:, None] == i) & (side[None, :] == j))
        x, y = np.nonzero(keep)
        return pa.table([samples[x], samples[y], shared[x, y].astype(np.int64), same[x, y].astype(np.int64)], schema=schema)

    found = rows.groupBy("block", "i", "j").applyInArrow(multiply, "a long, b long, shared long, same long")
    return found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.sum("same").alias("same"))
