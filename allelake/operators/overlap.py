"""Joins of closed intervals by bins, and what follows from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BIN = 1 << 14


def overlaps(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of rows on one chrom with a common position; the right side's columns but chrom get the prefix r_.

    Both sides are cut into bins and joined on (chrom, bin); a pair counts in the first bin that both reach, so no pair
    comes twice and no distinct is needed.
    """
    spread = lambda df, s, e: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    other = right.select("chrom", *(F.col(c).alias(f"r_{c}") for c in right.columns if c != "chrom"))
    both = spread(left, "start", "end").join(spread(other, "r_start", "r_end"), ["chrom", "bin"])
    first = F.floor(F.greatest("start", "r_start") / width)
    return both.filter((F.col("start") <= F.col("r_end")) & (F.col("end") >= F.col("r_start")) & (F.col("bin") == first)).drop("bin")


def tallies(asked: DataFrame, intervals: DataFrame, width: int = BIN) -> DataFrame:
    """How the intervals of each listed sample meet an interval, without a row a pair: key, sample, n_other, other, ref.

    asked has key, chrom, start, end and missing, an array of samples; intervals have chrom, start, end, sample,
    is_reference and gt. n_other counts a sample's other intervals with a common position, other is the genotype of a
    single one, ref the least genotype of reference intervals. A row comes for each bin that an asked interval reaches; an
    interval counts in the first bin that both reach, so n_other adds up. Empty intervals (ending one before their start) meet
    what holds both of their ends.

    In a bin the starts up to an end less the ends before a start are the intervals between them: two searches in sorted
    places, however many intervals lie upon each other.
    """
    place = lambda c: F.floor(F.col(c) / width)
    spread = lambda df: df.withColumn("bin", F.explode(F.sequence(place("start"), F.greatest(place("start"), place("end")))))
    left = spread(asked.select("key", "chrom", "start", "end", "missing").filter("chrom IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL"))
    right = spread(intervals.select("chrom", "start", "end", "sample", "is_reference", "gt").filter("chrom IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL AND sample IS NOT NULL AND is_reference IS NOT NULL"))
    # Places from the bin's first position; what reaches in from before or out behind stands just outside of the bin.
    low = F.col("bin") * width
    inside = lambda c: F.least(F.greatest(F.col(c) - low, F.lit(-1)), F.lit(width)).cast("int")
    left = left.select("chrom", "bin", "key", "missing", inside("start").alias("start"), F.when(F.col("end") < F.col("start"), F.greatest(F.col("end") - low, F.lit(-2)).cast("int")).otherwise(inside("end")).alias("end"))
    right = right.select(F.col("chrom").alias("r_chrom"), F.col("bin").alias("r_bin"), "sample", "is_reference", "gt", inside("start").alias("start"), inside("end").alias("end"))
    key, sample = asked.schema["key"].dataType, asked.schema["missing"].dataType.elementType
    ddl = f"key {key.simpleString()}, sample {sample.simpleString()}, n_other long, other string, ref string"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        of = a["missing"].combine_chunks() if a.num_rows else pa.array([], pa.list_(pa.int64()))
        which = np.repeat(np.arange(len(of)), pc.list_value_length(of).to_numpy(zero_copy_only=False).astype(np.int64))
        keys, samples, zero = a["key"].take(pa.array(which)), of.flatten(), np.zeros(len(which), np.int64)
        if not b.num_rows or not len(which):
            none = pa.nulls(len(which), pa.string())
            return pa.table({"key": keys, "sample": samples, "n_other": zero, "other": none, "ref": none})
        known = pc.unique(b["sample"])
        code = lambda x: pc.fill_null(pc.index_in(x, known), len(known)).to_numpy().astype(np.int64) * (width + 4) + 2
        base, own = code(samples), code(b["sample"])
        first, last = base + a["start"].to_numpy()[which], base + a["end"].to_numpy()[which]
        start, end, reference = own + b["start"].to_numpy(), own + b["end"].to_numpy(), b["is_reference"].to_numpy()
        names = sorted(x for x in pc.unique(b["gt"]).to_pylist() if x is not None)
        gt = pc.fill_null(pc.index_in(b["gt"], pa.array(names, pa.string())), -1).to_numpy().astype(np.int64) + 1
        n, names_sum = _meeting(start, end, gt, ~reference, base, first, last)
        other, ref = np.where(n == 1, names_sum, 0), zero.copy()
        for k in np.unique(gt[reference & (gt > 0)])[::-1].tolist():
            ref[_meeting(start, end, gt, reference & (gt == k), base, first, last)[0] > 0] = k
        named = lambda x: pa.array(names, pa.string()).take(pa.array(x - 1, mask=x == 0))
        return pa.table({"key": keys, "sample": samples, "n_other": n, "other": named(other), "ref": named(ref)})

    return left.groupBy("chrom", "bin").cogroup(right.groupBy("r_chrom", "r_bin")).applyInArrow(run, ddl)


def _meeting(start, end, weight, chosen, base, first, last) -> tuple[np.ndarray, np.ndarray]:
    """Of each asked place [first, last], how many chosen intervals [start, end] meet it, and the sum of their weights. base: where the bin of the asked sample begins."""
    start, end, weight = start[chosen], end[chosen], weight[chosen]
    before = first < base  # begun in an earlier bin: what reaches in from there has been counted

    def up_to(places, kept, asked, side):
        order = np.argsort(places[kept], kind="stable")
        at = np.searchsorted(places[kept][order], asked, side)
        return at, np.append(0, np.cumsum(weight[kept][order]))[at]

    every = np.ones(len(start), bool)
    n, w = up_to(start, every, last, "right")
    for out, gone in zip((n, w), up_to(end, every, first, "left")):
        out -= np.where(before, 0, gone)
    if before.any():
        for out, gone in zip((n, w), up_to(start, every, base - 1, "right")):
            out -= np.where(before, gone, 0)
    empty = last < first
    if empty.any() and (end < start).any():  # an empty interval ends before an empty place that it does not begin before
        for sign, side in ((1, "right"), (-1, "left")):
            for out, more in zip((n, w), up_to(start, end < start, np.where(side == "right", first, last + 1), side)):
                out += np.where(empty & ~before, sign * more, 0)
    return n, w


def shared_percent(pairs: DataFrame) -> DataFrame:
    """The share of the right interval that the left one covers, in percent."""
    shared = F.least("end", "r_end") - F.greatest("start", "r_start") + 1
    return pairs.withColumn("percent", 100.0 * shared / (F.col("r_end") - F.col("r_start") + 1))


def merged(intervals: DataFrame, gap: int = 1, width: int = BIN, totals: tuple[str, ...] = ()) -> DataFrame:
    """Overlapping and touching intervals as one: chrom, start, end, n, and sums of the columns in totals.

    Windows go over the rows of one bin; what reaches into a bin from before it comes from one row a bin, so a chromosome
    never meets in one task as a whole.
    """
    rows = intervals.select("chrom", "start", "end", *totals, F.floor(F.col("start") / width).alias("bin"))
    earlier = W.partitionBy("chrom").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = rows.groupBy("chrom", "bin").agg(F.max("end").alias("top")).select("chrom", "bin", F.max("top").over(earlier).alias("before"))
    order = W.partitionBy("chrom", "bin").orderBy("start", "end")
    reach = F.greatest("before", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    marked = rows.join(bins, ["chrom", "bin"]).withColumn("new", F.coalesce((F.col("start") > reach + gap).cast("int"), F.lit(1)))
    marked = marked.withColumn("k", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    offsets = marked.groupBy("chrom", "bin").agg(F.sum("new").alias("n")).select("chrom", "bin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    numbered = marked.join(offsets, ["chrom", "bin"]).withColumn("island", F.col("k") + F.col("offset"))
    sums = [F.sum(c).cast("long").alias(c) for c in totals]
    return numbered.groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), *sums).drop("island")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions in both of two sets of intervals, as intervals."""
    pairs = overlaps(merged(a), merged(b))
    return pairs.select("chrom", F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))


def nearby(points: DataFrame, window: int, *by: str, width: int = BIN) -> DataFrame:
    """Of each row, how many rows of its group start within window positions of it.

    Rows are dealt out by group and bin, and stand as guests in the neighbouring bin that their window reaches.
    """
    width = max(width, window + 1)
    bin_of = lambda shift: F.floor((F.col("start") + shift) / width)
    placed = points.withColumn("bin_", F.explode(F.array_distinct(F.array(bin_of(-window), bin_of(0), bin_of(window)))))
    around = W.partitionBy(*by, "bin_").orderBy("start").rangeBetween(-window, window)
    return placed.withColumn("n_near", F.count(F.lit(1)).over(around) - 1).filter(F.col("bin_") == bin_of(0)).drop("bin_")


def islands(depth: DataFrame, low: int, high: int) -> DataFrame:
    """Runs of neighbouring positions whose depth lies in [low, high]: chrom, start, end, and their total depth."""
    inside = depth.filter(F.col("depth").between(low, high)).select("chrom", F.col("pos").alias("start"), F.col("pos").alias("end"), F.col("depth").alias("total"))
    return merged(inside, totals=("total",)).drop("n")
