"""Packing token ids into windows by Karmarkar-Karp differencing (operator 10).

Documents are cut freely: whole windows first, the rest in small pieces, which multiway differencing deals out to
windows of nearly equal length. When a window exceeds the capacity, the count of windows rises and dealing starts anew.
What is left at the end of an input split, less than WINDOWS windows, is dealt together with what other splits leave.
"""

from __future__ import annotations

import heapq
import itertools
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, library

WINDOW = 1024
#: Remainders are cut to pieces of at most so many ids; so many windows are dealt out together.
PIECE, WINDOWS = 256, 128


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Items of each of the ways. Partial partitions with the largest spreads are merged, the largest sums of one with the smallest of the other.

    A partial partition is a list of (sum, order, items) in ascending order; ways that are not listed are empty.
    """
    order = itertools.count()
    heap = [(-n, next(order), [(n, i, (i,))]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        shared = len(a) + len(b) - ways  # as many of each must share a way
        if shared <= 0:
            joined = sorted(a + b)
        else:
            joined = sorted([*((x[0] + y[0], x[1], x[2] + y[2]) for x, y in zip(a[:shared], reversed(b[:shared]))), *a[shared:], *b[shared:]])
        least = joined[0][0] if len(joined) == ways else 0
        if least:
            joined = [(n - least, i, held) for n, i, held in joined]
        heapq.heappush(heap, (-joined[-1][0], next(order), joined))
    held = [list(x[2]) for x in heap[0][2]] if heap else []
    return held + [[] for _ in range(ways - len(held))]


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of items, none above capacity; as few as differencing finds."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, ways)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return windows
        ways += 1


def pack(docs: DataFrame, vocabulary: str, end: int, window: int = WINDOW) -> DataFrame:
    """Where each piece of each document goes.

    Each id lies in exactly one piece; the end id closes each document, so that a null or empty text is one id.
    Sequences are gapless from offset 0 and at most window long. Repeated rows are packed each for itself. Sequence ids
    follow from the place of the input split and, for what splits leave, from the hash of the piece, so a task that runs
    again gives the same ids. An empty table gives no pieces; other columns are not read.
    """
    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = common.stored(_by_split(docs, vocabulary, end, window, ddl), "packed")
    left = placed.filter("sequence_id is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    return placed.filter("sequence_id is not null").unionByName(_left_over(left, max(1, tokens // (window * WINDOWS)), window, ddl))


def _left_over(left: DataFrame, tasks: int, window: int, ddl: str) -> DataFrame:
    """Windows of the pieces that splits leave, dealt in so many tasks; none holds many more pieces than WINDOWS windows at a time."""
    schema = common.arrow_schema(ddl)

    def run(batches):
        sequence = itertools.count((1 << 62) + (TaskContext.get().partitionId() << 36))
        held: list[tuple] = []
        total = 0

        def settle():
            rows = []
            for way in deal([x[2] for x in held], window):
                number, offset = next(sequence), 0
                for i in way:
                    rows.append((*held[i], number, offset))
                    offset += held[i][2]
            held.clear()
            return common.batch(schema, *zip(*rows))

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                total += row[2]
                if total >= window * (WINDOWS - 1):
                    yield settle()
                    total = 0
        if held:
            yield settle()

    return left.repartition(tasks, *left.columns).sortWithinPartitions(*left.columns).mapInArrow(run, ddl)


def _by_split(docs: DataFrame, vocabulary: str, end: int, window: int, ddl: str) -> DataFrame:
    """The pieces of each input split in its own windows; sequence_id is null for what does not fill WINDOWS of them."""
    schema = common.arrow_schema(ddl)
    piece = max(1, min(PIECE, window))

    def run(batches):
        encoder = library.encoder(vocabulary)
        sequence = itertools.count(TaskContext.get().partitionId() << 36)
        rests: list[tuple] = []  # doc_id, start, ids, ids of the document
        total = 0
        rows: list[tuple] = []

        def place(doc, start, data, whole, number, offset):
            rows.append((doc, start, len(data) // 4, zlib.crc32(data), whole, number, offset))

        def settle():
            for held in deal([len(x[2]) // 4 for x in rests], window):
                number, offset = next(sequence), 0
                for i in held:
                    doc, start, data, whole = rests[i]
                    place(doc, start, data, whole, number, offset)
                    offset += len(data) // 4
            rests.clear()

        def out():
            got = common.batch(schema, *zip(*rows))
            rows.clear()
            return got

        for b in common.parts(batches, 1, library.CHUNK):
            for doc, data in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist(), end)):
                n, start = len(data) // 4, 0
                while n - start >= window:
                    place(doc, start, data[4 * start : 4 * (start + window)], n, next(sequence), 0)
                    start += window
                while start < n:
                    part = data[4 * start : 4 * (start + piece)]
                    rests.append((doc, start, part, n))
                    start += len(part) // 4
                    total += len(part) // 4
                if total >= window * WINDOWS - piece:
                    settle()
                    total = 0
            if rows:
                yield out()
        for doc, start, data, whole in rests:
            place(doc, start, data, whole, None, None)
        if rows:
            yield out()

    return common.texts(docs).mapInArrow(run, ddl)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)
