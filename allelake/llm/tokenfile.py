"""Token ids as patched frame-of-reference blocks (operator 9).

A segment holds whole documents in order: a header, the document index, the index of block starts, then the blocks. A
block of BLOCK ids subtracts its minimum and packs the differences at the width that holds the PERCENTILE of them; what
does not fit stands in an exception list of positions and full values. Segments are rows of a table, so Spark's own
commit protocol covers them on any file system, and a block is found from its segment without decoding the others.

Segment, little-endian: magic "PFR1"; documents, ids and blocks as uint32; per document doc_id int64 and length
uint32; per block the offset of its start, uint32, and at the end the offset behind the last; blocks.
Block: minimum uint32, count of ids uint16, width uint8, count of exceptions uint16, packed bits, exception positions
uint8, exception values uint32. Bits are padded to whole bytes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common, library

BLOCK, PERCENTILE, SEGMENT_IDS = 256, 90, 1 << 20
#: UTF-8 bytes of the texts of a shard, about, once there are more of them than shuffle partitions.
SHARD_BYTES = 128 << 20
MAGIC = b"PFR1"
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
HEAD = struct.Struct("<4sIII")
BLOCK_HEAD = struct.Struct("<IHBH")


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    return np.where(x == 0, 0, np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) + 1)


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of ids, and where each starts; one more offset stands behind the last."""
    n = len(ids)
    count = -(-n // BLOCK)
    if not count:
        return b"", np.zeros(1, np.uint32)
    grid = np.resize(np.append(ids.astype(np.uint32), np.full(count * BLOCK - n, ids[-1], np.uint32)), (count, BLOCK))
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    used = np.full(count, BLOCK)
    used[-1] = n - (count - 1) * BLOCK
    place = int(np.ceil(BLOCK * PERCENTILE / 100)) - 1
    width = _widths(np.partition(rest, place, axis=1)[:, place])
    over = (rest >> width[:, None].astype(np.uint32) > 0) & (np.arange(BLOCK) < used[:, None])
    over &= width[:, None] < 32
    blocks: list[bytes] = [b""] * count
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for part in np.array_split(rows, -(-len(rows) // 512)):
            wide = rest[part].astype("<u2" if w <= 16 else "<u4")
            bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").reshape(len(part), BLOCK, -1)[:, :, :w]
            packed = np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")
            for row, i in zip(packed, part.tolist()):
                blocks[i] = row[: (int(used[i]) * w + 7) // 8].tobytes()
    which, spot = np.nonzero(over)
    cut = np.searchsorted(which, np.arange(count + 1))
    values = grid[which, spot].astype("<u4")
    spot = spot.astype(np.uint8)
    for i in range(count):
        a, b = cut[i], cut[i + 1]
        blocks[i] = BLOCK_HEAD.pack(int(low[i]), int(used[i]), int(width[i]), int(b - a)) + blocks[i] + spot[a:b].tobytes() + values[a:b].tobytes()
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype(np.uint32)
    return b"".join(blocks), offsets


def unpack_block(data: bytes, at: int) -> np.ndarray:
    """The ids of the block that starts at byte at."""
    low, used, width, extra = BLOCK_HEAD.unpack_from(data, at)
    at += BLOCK_HEAD.size
    size = (used * width + 7) // 8
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: used * width].reshape(used, width)
        out = (bits @ (1 << np.arange(width, dtype=np.int64))).astype(np.uint32) + np.uint32(low)
    else:
        out = np.full(used, low, np.uint32)
    if extra:
        at += size
        out[np.frombuffer(data, np.uint8, extra, at)] = np.frombuffer(data, "<u4", extra, at + extra)
    return out


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of neighbouring blocks; full blocks of one width are unpacked together."""
    starts = starts.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    count = len(starts)
    if not count:
        return np.zeros(0, np.uint32)
    head = raw[starts[:, None] + np.arange(BLOCK_HEAD.size)]
    low = head[:, :4].copy().view("<u4")[:, 0]
    used = head[:, 4:6].copy().view("<u2")[:, 0].astype(np.int64)
    width, extra = head[:, 6].astype(np.int64), head[:, 7:9].copy().view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((count, BLOCK), np.uint32)
    bits_at = starts + BLOCK_HEAD.size
    packed = (used * width + 7) // 8
    for w in np.unique(width[used == BLOCK]).tolist():
        rows = np.flatnonzero((width == w) & (used == BLOCK))
        for part in np.array_split(rows, -(-len(rows) // 512)):
            if w:
                bits = np.unpackbits(raw[bits_at[part][:, None] + np.arange(BLOCK * w // 8)], axis=1, bitorder="little").reshape(-1, w)
                wide = np.zeros((len(bits), 16 if w <= 16 else 32), np.uint8)
                wide[:, :w] = bits
                out[part] = np.packbits(wide, axis=1, bitorder="little").view("<u2" if w <= 16 else "<u4").reshape(len(part), BLOCK)
            out[part] += low[part][:, None]
    if extra.any():
        row = np.repeat(np.arange(count), extra)
        k = np.arange(len(row)) - np.repeat(np.cumsum(extra) - extra, extra)
        at = (bits_at + packed)[row]
        value_at = at + extra[row] + 4 * k
        out[row, raw[at + k]] = np.ascontiguousarray(raw[value_at[:, None] + np.arange(4)]).view("<u4")[:, 0]
    for i in np.flatnonzero(used < BLOCK).tolist():
        out[i, : used[i]] = unpack_block(data, int(starts[i]))
    if (used == BLOCK).all():
        return out.reshape(-1)
    return out[np.arange(BLOCK) < used[:, None]]


def write_segment(doc_ids: list[int], documents: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(documents), "<u4")
    blocks, offsets = pack(ids)
    index = np.zeros(len(documents), [("doc", "<i8"), ("n", "<u4")])
    index["doc"], index["n"] = [NO_ID if d is None else d for d in doc_ids], [len(d) // 4 for d in documents]
    start = HEAD.size + index.nbytes + 4 * len(offsets)
    return HEAD.pack(MAGIC, len(documents), len(ids), len(offsets) - 1) + index.tobytes() + (offsets + np.uint32(start)).astype("<u4").tobytes() + blocks


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id and length of each document, and all ids."""
    magic, docs, n, blocks = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    index = np.frombuffer(data, [("doc", "<i8"), ("n", "<u4")], docs, HEAD.size)
    offsets = np.frombuffer(data, "<u4", blocks + 1, HEAD.size + index.nbytes)
    ids = unpack(data, offsets[:-1])
    if len(ids) != n:
        raise ValueError("a segment of token ids is damaged")
    return index["doc"], index["n"], ids


def write_ids(docs: DataFrame, vocabulary: str, end: int, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """The stored segments of all whole texts in ascending doc_id order.

    Columns: shard (ascending with doc_id), first (ids of the shard before the segment), n_ids, segment. A null text
    counts as empty and holds the end id alone; a null doc_id comes first. Equal doc_ids stand together, in order of a hash of their text. A document that is longer
    than segment_ids fills a segment by itself. An empty table gives no segments.
    """
    ddl = "shard int, first long, n_ids long, segment binary"
    schema = common.arrow_schema(ddl)

    def run(batches):
        encoder = library.encoder(vocabulary)
        shard = TaskContext.get().partitionId()
        first, doc_ids, held, n = 0, [], [], 0

        def flush():
            return common.batch(schema, [shard], [first], [n], [write_segment(doc_ids, held)])

        for b in batches:
            keys, all_texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in common.chunks([len(t) for t in all_texts], library.CHUNK):
                for key, ids in zip(keys[i:j], encoder.encode(all_texts[i:j], end)):
                    if held and n + len(ids) // 4 > segment_ids:
                        yield flush()
                        first, doc_ids, held, n = first + n, [], [], 0
                    doc_ids.append(key)
                    held.append(ids)
                    n += len(ids) // 4
        if held:
            yield flush()

    rows = common.texts(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    # Rows of one doc_id may lie in several shards: they are ordered by a hash of their text first.
    rows = rows.withColumn("mark", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")
    return common.stored(ordered.mapInArrow(run, ddl), "token-ids")


def read_ids(segments: DataFrame, keep_ids: bool = True) -> DataFrame:
    """One row per document, from the segments alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, with keep_ids, ids."""
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("held"))
    # One row a shard, hence small whatever the input.
    before = totals.select("shard", (F.sum("held").over(W.orderBy("shard")) - F.col("held")).alias("before"))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    schema = common.arrow_schema(ddl)

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                doc_ids, counts, ids = read_segment(b.column(2)[row].as_py())
                counts = counts.astype(np.int64)
                ends = np.cumsum(counts)
                begins = ends - counts
                data = ids.astype("<u4").tobytes()
                each = [data[4 * a : 4 * e] for a, e in zip(begins.tolist(), ends.tolist())]
                yield common.batch(schema, pa.array(doc_ids, mask=doc_ids == NO_ID), begins + (b.column(0)[row].as_py() + b.column(1)[row].as_py()), counts, [zlib.crc32(x) for x in each], *[each] * keep_ids)

    return segments.join(F.broadcast(before), "shard").select("before", "first", "segment").mapInArrow(run, ddl)


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    segments = write_ids(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_ids(segments, keep_ids=False)
