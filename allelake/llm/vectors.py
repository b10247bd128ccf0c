"""Near-duplicate vectors by int8 tile products with error bounds (operator 5).

Unit vectors of one label are cut into tiles. A vector x is held as s * q + e with q of 8-bit integers, so for two
vectors |x.y - s t (q.r)| <= |e| |t r| + |f| |s q| + |e| |f|; these norms are kept with each vector. A tile's products of
integers are exact, and only pairs whose bound reaches THRESHOLD are computed again from the original components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components
from .ordered import Forest

THRESHOLD = 0.93
#: Vectors in a tile, about.
TILE = 1024
#: More than double precision loses over any vector here.
SLACK = 1e-9


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit values, scales, norms of what they stand for and norms of what they leave out."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y (of x alone if y is none) whose cosine, in double precision, reaches the threshold."""
    def unit(v):
        return v / np.linalg.norm(v, axis=1)[:, None]

    a = unit(x)
    b = a if y is None else unit(y)
    qa, sa, na, ea = quantised(a)
    qb, sb, nb, eb = (qa, sa, na, ea) if y is None else quantised(b)
    rows, columns = [], []
    exact = 127 * 127 * x.shape[1] < 1 << 24  # then 32-bit floats hold the integer products
    kind = np.float32 if exact else np.float64
    for i in range(0, len(a), 256):
        product = (qa[i : i + 256].astype(kind) @ qb.astype(kind).T).astype(np.float64)
        bound = product * sa[i : i + 256, None] * sb[None, :] + ea[i : i + 256, None] * nb[None, :] + (na + ea)[i : i + 256, None] * eb[None, :]
        r, c = np.nonzero(bound >= threshold - SLACK)
        r += i
        if y is None:
            r, c = r[c > r], c[c > r]
        for k in range(0, len(r), 1 << 16):
            p, q = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
            u, v = x[p], (x if y is None else y)[q]
            cosine = np.einsum("ij,ij->i", u, v) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v)))
            rows.append(p[cosine >= threshold])
            columns.append(q[cosine >= threshold])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *columns])


def classes(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine is threshold or more. Null and zero vectors,
    and those with null or non-finite components, link with nothing. Equal vectors of one label enter the tiles once,
    with their number; zeros of either sign are equal. Vectors of different lengths do not link. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    fine = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    rows = rows.withColumn("v", F.when(fine, F.transform("v", lambda x: x + F.lit(0.0))))
    valid = rows.filter("v is not null").withColumn("digest", F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",").cast("binary")))
    once = common.materialize(valid.groupBy("label", "digest").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("times"), F.first("v").alias("v")))
    sizes = once.groupBy("label", F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("parts"))
    member = once.withColumn("dim", F.size("v")).join(sizes, ["label", "dim"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    tiles = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "label", "dim", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "vec_id", "times", "v"
    )
    schema = common.arrow_schema("vec_id long, n long, root long")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id").combine_chunks()
        ids, times, side = table["vec_id"].to_numpy(), table["times"].to_numpy(), table["part"].to_numpy()
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])  # by powers of two: no square overflows or vanishes
        low = table["i"][0].as_py()
        if low == table["j"][0].as_py():
            a, b = tile_links(x, None, threshold)
        else:
            left, right = np.flatnonzero(side == low), np.flatnonzero(side != low)
            if not len(left) or not len(right):
                return schema.empty_table()
            a, b = tile_links(x[left], x[right], threshold)
            a, b = left[a], right[b]
        n = np.bincount(a, times[b], len(ids)) + np.bincount(b, times[a], len(ids))
        forest = Forest(len(ids))
        for p, q in zip(a.tolist(), b.tolist()):
            forest.join(p, q)
        hit = np.flatnonzero(n)
        root = np.array([forest.root(k) for k in hit.tolist()], np.int64)
        return pa.table([ids[hit], n[hit].astype(np.int64), ids[root] if len(root) else ids[:0]], schema=schema)

    found = common.materialize(tiles.groupBy("label", "dim", "i", "j").applyInArrow(compare, "vec_id long, n long, root long"))
    linked = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    joined = components.components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    of_class = (
        once.join(linked, "vec_id", "left")
        .join(joined.withColumnRenamed("id", "vec_id"), "vec_id", "left")
        .select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    )
    settled = valid.select("vec_id", "label", "digest").join(of_class, ["label", "digest"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return settled.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "embeddings"))
