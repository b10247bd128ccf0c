"""Exact removal of long repeats by blockwise suffix sorting (operator 2).

Suffixes go to blocks by the anchor of their first LENGTH bytes (anchors.py), so equal ones meet. A task sorts one batch of
blocks at a time by the difference-cover method: the ranks of SPAN bytes at the positions of a difference cover of
period PERIOD are computed first; suffixes are sorted by their first PERIOD bytes, and a tie of any length is resolved
by the ranks at the cover position that both suffixes reach after the same number of bytes. Only blocks with texts
that differ are sorted at all: contexts that repeat as a whole are settled by counting. A block of very many contexts is
split by longer strings: its windows are cut to ranges of WIDTHS offsets from the anchor, and a range's block is the string that
all of its windows share, which is up to all of their bytes.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType, StructField, StructType

from . import anchors, common

LENGTH = 200
#: A perfect difference set: each difference modulo PERIOD is that of two members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
SPAN = 8 * PERIOD
CHUNK = 1 << 20
#: Contexts of one block that a task sorts; blocks beyond are split by longer strings first.
BLOCK_MOST = 512
#: Offsets of a block's windows from its anchor: of all of them, of a split block, and of one split again, whose windows are the string itself.
WIDTHS = 13, 1
#: Stands for a missing doc_id where rows are told apart.
NO_ID = -(2**63)
#: Bytes of contexts sorted together.
BATCH_BYTES = 1 << 20
#: Texts of which a task remembers the digests, so as to look at copies once.
REMEMBERED = 100_000


def _shifts() -> np.ndarray:
    """By residues of two positions: after how many bytes both stand in the cover."""
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER)
    return out


SHIFT = _shifts()


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; zeros stand behind the end."""
    x, step = np.append(raw, np.zeros(8, np.uint8)).astype(np.uint64), 1
    while step < 8:
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
        step *= 2
    return x[: len(raw)]


def _dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks by several keys, the first one first; equal rows share a rank."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, windows: np.ndarray, blocks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For the windows of all contexts in order: does the same LENGTH-byte string start elsewhere in its block?

    starts, lengths: of each context in raw; windows: how many windows start at each context's first bytes; weights:
    how many times the context occurs (one that occurs twice repeats by itself).
    """
    which = np.repeat(np.arange(len(starts)), windows)
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(len(which))
    out = weights[which] > 1
    if not len(at):
        return out
    # Windows whose hash does not recur in the block cannot repeat; they need no sorting.
    h64, h128 = anchors.doubled(raw, 128, (64,))
    h8 = anchors.doubled(raw, 8)[0]
    whole = anchors.joined(anchors.joined(h128[at], h64[at + 128]), h8[at + 192])
    whole = anchors.joined(whole, blocks[which].astype(np.uint64))
    order = np.argsort(whole)
    s = whole[order]
    same = s[1:] == s[:-1]
    maybe = np.zeros(len(at), bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    pick = np.flatnonzero(maybe)
    if not len(pick):
        return out
    p, block = at[pick], blocks[which[pick]]
    residue = ((p - starts[which[pick]]) % PERIOD).astype(np.int64)
    eight = _words(raw)
    # Ranks of the cover sample: PERIOD bytes, then doubled; only contexts with windows left take part.
    live = np.zeros(len(starts), bool)
    live[which[pick]] = True
    mine = np.concatenate([np.arange(PERIOD)[np.isin(np.arange(PERIOD), COVER)]])
    size = np.where(live, np.maximum(0, lengths - PERIOD + 1), 0)
    owner = np.repeat(np.arange(len(starts)), size)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    inside = np.isin(inner % PERIOD, mine)
    owner, inner = owner[inside], inner[inside]
    sample = starts[owner] + inner
    rank = np.full(len(raw) + 1, -1, np.int64)
    rank[sample] = _dense([eight[sample], eight[sample + 8], eight[sample + 13]])
    span = PERIOD
    while span < SPAN:
        fits = inner + 2 * span <= lengths[owner]
        owner, inner, sample = owner[fits], inner[fits], sample[fits]
        joint = _dense([(rank[sample] << 32) | rank[sample + span]])
        rank[sample] = joint
        span *= 2
    tail = _dense([eight[p + LENGTH - 32 + 8 * k] for k in range(4)])
    order = np.lexsort((eight[p + 13], eight[p + 8], eight[p], block))

    def cuts(keys: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        new = np.ones(len(order), bool)
        new[1:] = False
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
        return np.flatnonzero(new)

    first = cuts([block, eight[p], eight[p + 8], eight[p + 13]], order)
    found = np.zeros(len(p), bool)
    while True:
        count = np.diff(np.append(first, len(order)))
        open_ = count > 1
        if not open_.any():
            break
        order = order[np.repeat(open_, count)]
        count = count[open_]
        first = np.cumsum(count) - count
        segment = np.repeat(np.arange(len(first)), count)
        pivot = order[first + count // 2][segment]
        d = SHIFT[residue[order], residue[pivot]]
        a, b = rank[p[order] + d], rank[p[pivot] + d]
        side = np.where(a != b, np.sign(a - b), np.sign(tail[order] - tail[pivot])) + 1
        equal = side == 1
        twins = np.bincount(segment[equal], minlength=len(first)) > 1
        found[order[equal & twins[segment]]] = True
        rest = ~equal
        order, key = order[rest], (segment * 3 + side)[rest]
        turn = np.argsort(key, kind="stable")
        order, key = order[turn], key[turn]
        first = np.flatnonzero(np.diff(key, prepend=-1)) if len(key) else np.zeros(0, np.int64)
    out[pick[found]] = True
    return out


ANCHOR = "h long, c long, doc_id long, mark long, s long, n int, o int, w int"


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """One row per anchor: the hash of its string, the hash of its context (all bytes of its windows), where its windows start, and a weight.

    o is the place of the anchor's string behind the first window. Contexts that recur among the texts at hand are settled at once. One of them goes on with their number as its
    weight; the others weigh nothing and take a random key, so a string that recurs everywhere does not gather in one task.
    """
    schema = common.arrow_schema(ANCHOR)

    def run(batches):
        seen: set[bytes] = set()
        for b in common.parts(batches):
            keys, data, marks = b.column(0).to_numpy(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_numpy()
            for i, j in common.chunks([len(x) for x in data], CHUNK):
                take = []
                for k in range(i, j):  # a copy of a text of this task adds nothing: copies are settled by their digests
                    digest = hashlib.md5(data[k]).digest()
                    if digest not in seen:
                        seen.add(digest)
                        take.append(k)
                if len(seen) > REMEMBERED:
                    seen.clear()
                raw = np.frombuffer(b"".join(data[k] for k in take), np.uint8)
                ends = np.cumsum(np.array([len(data[k]) for k in take], np.int64))
                doc, s, n, at = anchors.runs(raw, ends, length)
                if not len(doc):
                    continue
                begin = np.concatenate(([0], ends[:-1]))[doc]
                h = anchors.gram_hashes(raw, at)
                c = anchors.joined(common.span_hashes(raw, s, s + n + (length - 1)), (at - s).astype(np.uint64))
                pair = anchors.joined(h, c)
                order = np.argsort(pair)
                new = np.append(True, pair[order][1:] != pair[order][:-1])
                weight = np.zeros(len(pair), np.int32)
                weight[order[new]] = np.diff(np.append(np.flatnonzero(new), len(pair)))
                ids, own = keys[np.array(take)][doc], marks[np.array(take)][doc]
                h = np.where(weight > 0, h, common.mixed(common.mixed(own.view(np.uint64)) + s.astype(np.uint64)))
                yield common.batch(schema, h.view(np.int64), c.view(np.int64), ids, own, s - begin, n.astype(np.int32), (at - s).astype(np.int32), weight)

    return docs.mapInArrow(run, ANCHOR)


CONTEXT = "h long, c long, nc long, doc_id long, mark long, s long, n int, o int, bytes binary"
SPANS = "doc_id long, mark long, s long, e long"


def _contexts(wanted: DataFrame, docs: DataFrame, length: int, then=None, ddl: str = CONTEXT) -> DataFrame:
    """The bytes of the contexts asked for; the lists of one document are as long as its text at most.

    then: what becomes of their batches in the same task, with columns ddl. A Python operator behind this one would hold a
    second worker for each task, and all of an executor's workers take part in what follows.
    """
    lists = wanted.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("h", "c", "nc", "s", "n", "o")).alias("spots"))
    schema = common.arrow_schema(CONTEXT)

    def cut_out(batches):
        for b in common.parts(batches):
            keys, data, marks = b.column(0).to_numpy(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_numpy()
            spots = b.column(3)
            flat = spots.flatten()
            s, n = flat.field("s").to_numpy(), flat.field("n").to_numpy()
            counts = np.diff(spots.offsets.to_numpy())
            owner = np.repeat(np.arange(len(keys)), counts)
            cut = [data[k][x : x + m + length - 1] for k, x, m in zip(owner.tolist(), s.tolist(), n.tolist())]
            yield common.batch(schema, flat.field("h"), flat.field("c"), flat.field("nc"), keys[owner], marks[owner], s, n.astype(np.int32), flat.field("o"), cut)

    return docs.join(lists, ["doc_id", "mark"]).select("doc_id", "text", "mark", "spots").mapInArrow(cut_out if then is None else lambda batches: then(cut_out(batches)), ddl)


def _true_runs(mark: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of True within one owner."""
    edge = np.ones(len(mark) + 1, bool)
    edge[1:-1] = (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(edge)
    keep = mark[at[:-1]]
    return at[:-1][keep], at[1:][keep] - 1


def _sorted_blocks(contexts: DataFrame, length: int) -> DataFrame:
    """Byte ranges covered by windows that recur in their block, from a sort of each block's suffixes."""
    schema = common.arrow_schema(SPANS)

    def settle(columns: list[list]):
        h, nc, doc, own, s, n = (np.array(columns[k], np.int64) for k in (0, 2, 3, 4, 5, 6))
        data = columns[8]
        lengths = np.array([len(x) for x in data], np.int64)
        starts = np.cumsum(lengths) - lengths
        block = np.cumsum(np.diff(h, prepend=h[:1]) != 0)
        mark = repeated(np.frombuffer(b"".join(data), np.uint8), starts, lengths, n, block, nc)
        owner = np.repeat(np.arange(len(n)), n)
        mark &= nc[owner] == 1  # the others are settled already
        a, b = _true_runs(mark, owner)
        base = np.cumsum(n) - n
        k = owner[a]
        return common.batch(schema, doc[k], own[k], s[k] + a - base[k], s[k] + b - base[k] + length)

    def run(batches):
        held: list[list] = [[] for _ in range(9)]
        size = 0
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for row in zip(*columns):
                if size > BATCH_BYTES and row[0] != held[0][-1]:
                    yield settle(held)
                    held, size = [[] for _ in range(9)], 0
                for k, v in zip(held, row):
                    k.append(v)
                size += len(row[8])
        if held[0]:
            yield settle(held)

    return contexts.repartition("h").sortWithinPartitions("h", "c").mapInArrow(run, SPANS)


def _ranges(wanted: DataFrame, docs: DataFrame, width: int, length: int) -> DataFrame:
    """Anchor rows of ranges of width offsets, cut from the contexts asked for: contexts that share the bytes that all windows of a range share are a block."""
    schema = common.arrow_schema(ANCHOR)

    def run(batches):
        for b in common.parts(batches, column=8):
            h, _, nc, doc, own, s, n, o = (b.column(k).to_numpy().astype(np.int64) for k in range(8))
            data = b.column(8).to_pylist()
            raw = np.frombuffer(b"".join(data), np.uint8)
            start = np.cumsum([0, *map(len, data[:-1])])
            low, high = (o - n + 1) // width, o // width
            k = np.repeat(np.arange(len(h)), high - low + 1)
            part = low[k] + np.arange(len(k)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
            first = np.maximum(o[k] - width * part - width + 1, 0)
            last = np.minimum(o[k] - width * part, n[k] - 1)
            core = start[k] + o[k] - width * part  # where the last window of a whole range starts
            block = anchors.joined(anchors.joined(h[k].view(np.uint64), part.astype(np.uint64)), common.span_hashes(raw, core, core + length - width + 1, seed=1))
            whole = anchors.joined(common.span_hashes(raw, start[k] + first, start[k] + last + length), (o[k] - first).astype(np.uint64))
            yield common.batch(schema, block.view(np.int64), whole.view(np.int64), doc[k], own[k], s[k] + first, (last - first + 1).astype(np.int32), (o[k] - first).astype(np.int32), np.minimum(nc[k], 2).astype(np.int32))

    return _contexts(wanted, docs, length, run, ANCHOR)


def _marked(rows: DataFrame) -> DataFrame:
    """Anchor rows with nc, how often their context occurs, and whether they lead its rows; kh: contexts that the block has. Those of one occurrence go."""
    by_context, by_anchor = W.partitionBy("h", "c"), W.partitionBy("h")
    marked = (
        rows.repartition("h")
        .withColumn("nc", F.sum("w").over(by_context))
        .withColumn("lead", (F.row_number().over(by_context.orderBy(F.desc("w"), "doc_id", "mark", "s")) == 1) & (F.col("w") > 0))
        .withColumn("nh", F.sum("w").over(by_anchor))
        .filter("nh > 1 or w = 0")
        .withColumn("kh", F.sum(F.col("lead").cast("long")).over(by_anchor))
    )
    return common.stored(marked.drop("nh"), "anchors")


def _named(docs: DataFrame, *more) -> DataFrame:
    """doc_id, text and mark, a hash of the text: rows of one doc_id and mark have one text, also where doc_id is null or repeats."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"), *more)


def repeats(docs: DataFrame, length: int = LENGTH, block_most: int = BLOCK_MOST) -> tuple[DataFrame, DataFrame]:
    """Of named texts (_named) those of at least length bytes that have copies (doc_id, mark), and byte ranges covered by repeated strings in the other texts (doc_id, mark, s, e)."""
    if length != LENGTH:
        raise ValueError(f"the difference cover is laid out for {LENGTH} bytes")
    digests = docs.filter(F.octet_length("text") >= length).select("doc_id", "mark", F.md5(F.col("text").cast("binary")).alias("digest"))
    many = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    copies = digests.join(many, "digest", "left_semi").select("doc_id", "mark")
    rows, spans = _anchor_rows(docs, length), []
    for width in (*WIDTHS, None):
        marked = _marked(rows)
        spans.append(marked.filter("nc > 1 or w = 0").select("doc_id", "mark", "s", (F.col("s") + F.col("n") + (length - 1)).alias("e")))
        differ = marked.filter("kh > 1 and lead")
        small, large = differ.filter(F.col("kh") <= block_most), differ.filter(F.col("kh") > block_most)
        spans.append(_sorted_blocks(_contexts(small, docs, length), length))
        if width is None or large.isEmpty():
            break
        rows = _ranges(large, docs, width, length)
    return copies, functools.reduce(DataFrame.unionByName, spans)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_most: int = BLOCK_MOST, keep: bool = True) -> DataFrame:
    """What is left of each text without the bytes covered by strings of length bytes that also start elsewhere.

    A null text counts as empty; matches never cross documents; all copies of a repeat go, the first included. doc_id
    is carried along only: it may be null or occur in several rows, of one text (copies of each other) or of several. With
    keep, the column kept follows, the text that is left (characters that a cut has split go), and the column row with all
    columns of docs; without it, other columns are not read. An empty table gives no rows.
    """
    whole = [F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row")] if keep else []
    rows = _named(docs, F.col("doc_id").cast("long").alias("key"), *whole)
    copies, spans = repeats(_named(docs), length, block_most)
    lists = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    flags = copies.distinct().withColumn("copied", F.lit(True))
    plain = common.arrow_schema(RESULT + ", kept string" * keep)
    result = StructType([*StructType.fromDDL(RESULT), *([StructField("kept", StringType()), rows.schema["row"]] if keep else [])])

    def run(batches):
        for b in common.parts(batches):
            rows = []
            for key, text, spans, copied in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2), b.column(3).to_pylist()):
                if copied:
                    rows.append((key, len(text), len(text), 1, hashlib.sha256(b"").hexdigest(), "")[: len(plain)])
                    continue
                kept, n_spans, removed = text, 0, 0
                if spans.is_valid:
                    s, e = spans.values.field("s").to_numpy(), spans.values.field("e").to_numpy()
                    order = np.argsort(s, kind="stable")
                    s, reach = s[order], np.maximum.accumulate(e[order])
                    new = np.append(True, s[1:] > reach[:-1])
                    begin, end = s[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]
                    n_spans, removed = len(begin), int((end - begin).sum())
                    edges = [0, *np.stack((begin, end), 1).reshape(-1).tolist(), len(text)]
                    kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))
                rows.append((key, len(text), removed, n_spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if keep else "")[: len(plain)])
            if rows:
                made = common.batch(plain, *zip(*rows))
                yield pa.RecordBatch.from_arrays([*made.columns, *b.columns[4:]], names=result.names)

    joined = rows.join(lists, ["doc_id", "mark"], "left").join(flags, ["doc_id", "mark"], "left").select("key", "text", "spans", "copied", *(["row"] if keep else []))
    return joined.mapInArrow(run, result)


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), keep=False)
