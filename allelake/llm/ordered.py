"""Near-duplicate texts by order MinHash (operator 3).

A text is its sequence of five-word shingles, each labelled with how often it has occurred before. A sketch takes, for
each of several hash functions, the labelled shingles with the least hashes and keeps them in the order of the text;
texts that are close in edit distance share such tuples. Texts with a common tuple are candidates. A pair of candidates
is linked when a banded alignment (alignment.py) keeps THRESHOLD of the words of the longer text in order.

Candidates of one tuple form a bucket. All members are first aligned with the bucket's pivot, which joins a group of near
copies by as many links as it has members; then only members of components that are still apart are aligned, in tiles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, common, components

SHINGLE, THRESHOLD = 5, 0.8
#: Tuples in a sketch, and shingles in a tuple. Two texts that share i of u shingles in all are no candidates with a chance of
#: (1 - C(i, 2) / C(u, 2))^24, unless both have SHORT at most and share THRESHOLD of theirs.
TUPLES, TAKEN = 24, 2
#: Texts of so many shingles at most also meet by each of their rarest shingles.
SHORT = 40
#: Texts of a bucket that meet in one task are two parts of about so many, and of about so many bytes.
PART, PART_BYTES = 512, 8 << 20
CHUNK = 1 << 20


def shingles(documents: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Labelled hashes of the shingles of all documents in order, and where each document's begin."""
    word, cut = alignment.words(documents)
    counts = np.maximum(np.diff(cut) - SHINGLE + 1, 0)
    at = np.repeat(cut[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    x = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        x = common.mixed(x * np.uint64(0x9E3779B97F4A7C15) + word[at + k])
    begins = np.append(0, np.cumsum(counts))
    return alignment.labelled(x, begins), begins


def sketches(tagged: np.ndarray, cut: np.ndarray, tuples: int = TUPLES, taken: int = TAKEN) -> np.ndarray:
    """One row per document that has shingles: hashes of its tuples."""
    counts = np.diff(cut)
    some = np.flatnonzero(counts)
    begin, size = cut[:-1][some], counts[some]
    owner = np.repeat(np.arange(len(some)), size)
    out = np.zeros((len(some), tuples), np.uint64)
    for t in range(tuples):
        x = common.mixed(tagged ^ np.uint64((t + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        spots = []
        for _ in range(taken):
            least = np.minimum.reduceat(x, begin)
            hit = np.flatnonzero(x == least[owner])
            hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]
            spots.append(hit)
            x[hit] = np.uint64(2**64 - 1)
        key = np.full(len(some), t + 1, np.uint64)
        for at in np.sort(np.stack(spots), axis=0):
            key = common.mixed(key * np.uint64(0x9E3779B97F4A7C15) + tagged[at])
        out[:, t] = key
    return out


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def links(documents: list[bytes], side: np.ndarray, group: np.ndarray, both: bool) -> list[tuple[int, int]]:
    """Links that connect documents of different groups, no more than are needed. both: pairs within a side count, else only those of different sides."""
    word, cut = alignment.words(documents)
    size = np.diff(cut)
    longer = np.maximum(size[:, None], size[None, :])
    least = np.ceil(THRESHOLD * longer - 1e-9)
    enough = (np.minimum(size[:, None], size[None, :]) >= least) & (group[:, None] != group[None, :])
    if not both:
        enough &= side[:, None] != side[None, :]
    if enough.any():
        enough &= alignment.shared_words(alignment.labelled(word, cut), cut) >= least - 0.5
    forest, out = Forest(len(documents)), []
    lead: dict[int, int] = {}
    for i, g in enumerate(group.tolist()):
        forest.join(i, lead.setdefault(g, i))
    for i, j in np.argwhere(np.triu(enough, 1)).tolist():
        if forest.root(i) != forest.root(j) and alignment.alike(word[cut[i] : cut[i + 1]], word[cut[j] : cut[j + 1]], THRESHOLD):
            forest.join(i, j)
            out.append((i, j))
    return out


SKETCH = "row long, doc_id long, digest binary, size int, keys binary, few binary"


def _sketch(docs: DataFrame) -> DataFrame:
    schema = common.arrow_schema(SKETCH)

    def run(batches):
        for b in common.parts(batches, most=CHUNK):
            keys, data, row = b.column(0), b.column(1).cast(pa.binary()).to_pylist(), b.column(2)
            tagged, cut = shingles(data)
            made = iter(sketches(tagged, cut))
            few = [tagged[i:j].tobytes() if j - i <= SHORT else b"" for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
            drawn = [next(made).tobytes() if n else b"" for n in np.diff(cut).tolist()]
            yield common.batch(schema, row, keys, [hashlib.md5(x).digest() for x in data], [len(x) for x in data], drawn, few)

    return docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, SKETCH)


def _unpacked(texts: DataFrame, column: str = "keys") -> DataFrame:
    ddl = "node long, size int, key long"
    schema = common.arrow_schema(ddl)

    def run(batches):
        for b in batches:
            data = b.column(2).to_pylist()
            counts = np.array([len(x) // 8 for x in data], np.int64)
            yield common.batch(schema, np.repeat(b.column(0).to_numpy(), counts), np.repeat(b.column(1).to_numpy(), counts), np.frombuffer(b"".join(data), "<i8"))

    return texts.select("node", "size", column).mapInArrow(run, ddl)


def _rarest(texts: DataFrame) -> DataFrame:
    """Of each short text its rarest shingles, so many that the rest cannot make up the threshold.

    Two texts that have THRESHOLD of either's shingles in common share, by one order of all shingles, one of these.
    """
    all_ = _unpacked(texts.filter(F.octet_length("few") > 0), "few")
    placed = all_.join(all_.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    ordered = placed.groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("s"))
    most = F.size("s") - F.ceil(F.size("s") * THRESHOLD - 1e-9).cast("int") + 1
    rare = F.filter(F.slice("s", F.lit(1), most), lambda x: x["n"] > 1)
    return ordered.select("node", "size", F.explode(rare).alias("x")).select("node", "size", F.xxhash64(F.lit("few"), "x.key").alias("key"))


def _with_pivots(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (pivot, node) that are alike. A pivot's text goes to as many tasks as its members fill."""
    sizes = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    placed = components.spread(pairs, sizes, "pivot", pairs.count()).withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART)))
    rows = placed.select("pivot", "part", "node").unionByName(placed.select("pivot", "part", F.col("pivot").alias("node")).distinct())
    schema = common.arrow_schema("a long, b long")

    def run(batches):
        here, lead = None, None
        for b in common.parts(batches, column=3):
            word, cut = alignment.words(b.column(3).cast(pa.binary()).to_pylist())
            out = []
            for k, (pivot, part, node) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                mine = word[cut[k] : cut[k + 1]]
                if node == pivot:
                    here, lead = (pivot, part), mine.copy()
                elif here == (pivot, part) and alignment.alike(lead, mine, THRESHOLD):
                    out.append((pivot, node))
            if out:
                yield common.batch(schema, *zip(*out))

    dealt = rows.join(texts, "node").select("pivot", "part", "node", "text").repartition("pivot", "part")
    return dealt.sortWithinPartitions("pivot", "part", F.col("node") != F.col("pivot")).mapInArrow(run, "a long, b long")


def _in_tiles(member: DataFrame, texts: DataFrame, part: int) -> DataFrame:
    """Links between the components of members that share a bucket, found in tiles of two parts."""
    apart = member.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).filter("lo != hi")
    parts = F.greatest(F.ceil(F.col("n") / part), F.ceil(F.col("bytes") / PART_BYTES)).cast("int")
    dealt = member.join(common.stored(apart.select("key", parts.alias("parts")), "apart"), "key").withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "group", "node"
    )
    schema = common.arrow_schema("a long, b long")

    def compare(table: pa.Table) -> pa.Table:
        group = table["group"].to_numpy()
        if len(table) < 2 or (group == group[0]).all():
            return schema.empty_table()
        table = table.sort_by("node")
        group, side = table["group"].to_numpy(), table["part"].to_numpy()
        got = links(table["text"].cast(pa.binary()).to_pylist(), side, group, table["i"][0].as_py() == table["j"][0].as_py())
        return pa.table([pa.array([group[i] for i, _ in got], pa.int64()), pa.array([group[j] for _, j in got], pa.int64())], schema=schema)

    return tiles.join(texts, "node").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def _classes(docs: DataFrame, part: int) -> DataFrame:
    """doc_id, digest, component_id and kept of each row."""
    docs = common.texts(docs)
    sketched = common.stored(_sketch(docs), "sketches")
    n = sketched.count()
    # Equal texts are one node, named by the first of their rows.
    once = common.stored(
        sketched.groupBy("digest").agg(F.min("row").alias("node"), F.min_by("doc_id", "row").alias("lead"), F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("few").alias("few")),
        "texts-once",
    )
    searched = once.filter(F.octet_length("keys") > 0)
    keyed = common.stored(_unpacked(searched).unionByName(_rarest(searched)), "keys")
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("pivot"), F.max("node").alias("hi")).filter("n > 1")
    # Buckets with the same members are looked at once.
    buckets = common.stored(buckets.groupBy("n", "x", "pivot", "hi").agg(F.min("key").alias("key")).select("key", "pivot"), "buckets", n * TUPLES)
    member = common.stored(keyed.join(buckets, "key"), "members", n * TUPLES)
    wanted = once.join(member.select("node").distinct(), "node").select("node", "digest", F.col("lead").alias("doc_id"))
    texts = common.stored(_candidates(docs, wanted), "candidates")
    pairs = common.stored(member.filter("node != pivot").select("pivot", "node").distinct(), "pivots", n * TUPLES)
    found = common.stored(components.components(_with_pivots(pairs, texts)), "classes-by-pivot", n)
    member = common.stored(member.join(found.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("group")), "members", n * TUPLES)
    joined = common.stored(components.components(_in_tiles(member, texts, part)), "classes-by-tile", n)
    of_node = found.join(joined.select(F.col("id").alias("component"), F.col("component").alias("larger")), "component", "left").select("id", F.coalesce("larger", "component").alias("component"))
    of_node = of_node.unionByName(joined.join(found, "id", "left_anti"))
    grouped = common.stored(once.select("digest", "doc_id", "first", F.col("node").alias("id")).join(of_node, "id", "left").select("digest", "doc_id", "first", F.coalesce("component", "id").alias("component")), "classes", n)
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    least = least.select("component", "component_id", F.col("first.row").alias("kept_row"), "n")
    placed = common.stored(components.spread(grouped.select("digest", "component"), least, "component", grouped.count()).select("digest", "component_id", "kept_row"), "digests", n)
    return sketched.select("row", "doc_id", "digest").join(placed, "digest").select("doc_id", "digest", "component_id", (F.col("row") == F.col("kept_row")).alias("kept"))


def _candidates(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of each node that is wanted, once; nodes are named by the doc_id and digest of one of their rows."""
    named = docs.select(F.col("doc_id").alias("own"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("code"), "text")
    return named.join(wanted, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("code") == F.col("digest"))).groupBy("node").agg(F.first("text").alias("text"))


def classes(docs: DataFrame, part: int = PART) -> DataFrame:
    """One row per row of docs: doc_id, component_id (the least doc_id of its class), kept (one row of each class).

    A null text counts as empty. Equal texts are of one class, empty ones included, whatever their doc_id; texts under
    five words link to equal ones only. Rows are told apart by their place, not by doc_id: a doc_id may be null or
    occur with several texts, and of rows equal in doc_id and text one is kept. component_id is null where no row of the
    class has a doc_id. Copies of a text are settled by its digest and enter the search once. Buckets of any size are
    compared whole, so no group meets in one task. An empty table gives no rows; other columns are not read.
    """
    return _classes(docs, part).drop("digest")


def survivors(docs: DataFrame) -> DataFrame:
    """The row of docs that is kept of each class, with all its columns."""
    rows = _classes(docs, PART).groupBy("doc_id", "digest").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    # Rows equal in doc_id and text cannot be told apart by these: they go through a grouping of their own.
    special = common.stored(rows.filter("not stays or n > 1").select(F.col("doc_id").alias("key_id"), F.col("digest").alias("key_digest"), "stays"), "verdicts")
    columns = [docs[c] for c in docs.columns]
    digest = F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("key_id")) & (digest == F.col("key_digest"))
    unique = docs.join(special, same, "left_anti")
    repeated = docs.join(special.filter("stays"), same).groupBy("key_id", "key_digest").agg(F.first(F.struct(*columns)).alias("row")).select("row.*")
    return unique.unionByName(repeated)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))
