from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelake.llm import alignment, components, ordered, suffixes, vectors

from .conftest import SF, edge_rows


def _repeats(rows, length=200):
    n = collections.Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = {}
    for d, t in rows:
        mark = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        kept = bytes(c for c, m in zip(t, mark) if not m)
        out[d] = (len(t), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def _mixed_rows():
    rnd = random.Random(3)
    base = ["".join(rnd.choices("abcdefgh éü", k=rnd.choice([50, 250, 700, 3000]))) for _ in range(20)]
    rows = []
    for i in range(120):
        t = ""
        for _ in range(rnd.choice([0, 1, 2, 4])):
            b = rnd.choice(base)
            a = rnd.randrange(len(b))
            t += b[a : a + rnd.choice([100, 199, 200, 220, 400, 2000])]
            if rnd.random() < 0.5:
                t = t[: len(t) // 2] + rnd.choice("abc ") + t[len(t) // 2 :]
        t = rnd.choice([t, t, t, t, "ab" * rnd.choice([99, 100, 101, 300]), "x" * rnd.choice([199, 200, 201, 300])])
        rows.append((i, t))
    return rows


def test_cover_reaches_every_pair():
    for a in range(suffixes.PERIOD):
        for b in range(suffixes.PERIOD):
            d = suffixes.SHIFT[a, b]
            assert (a + d) % suffixes.PERIOD in suffixes.COVER and (b + d) % suffixes.PERIOD in suffixes.COVER


@pytest.mark.parametrize("most", [3, suffixes.BLOCK_MOST])
def test_op2(spark, most):
    rows = _mixed_rows()
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_most=most).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == _repeats([(d, t.encode()) for d, t in rows])


def test_op2_edges(clashing, nothing):
    got = {r.doc_id: r for r in suffixes.remove_repeats(clashing).collect()}
    rows = [*edge_rows(), (None, "without an id " * 30)]
    want = _repeats([(d, (t or "").encode()) for d, t in rows])
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == want
    assert got[None].row.lang == "en"
    assert suffixes.remove_repeats(nothing).count() == 0


def test_op2_rows_without_an_id_of_their_own(spark):
    """Null and repeated doc_ids, with equal and with different texts."""
    rnd = random.Random(7)
    make = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    a, b, c = make(400), make(390), make(260)
    rows = [(1, a), (1, b), (2, b[:250] + make(50)), (None, c), (None, "x" + c), (3, a[:210]), (3, a[:210]), (None, None), (None, ""), (4, make(500))]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = _repeats([(i, (t or "").encode()) for i, (_, t) in enumerate(rows)])
    mine = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert mine == collections.Counter((rows[i][0], *x) for i, x in want.items())


def test_op2_large_blocks(spark):
    """One string in many texts, with other bytes around it in each: its blocks are split by longer strings."""
    rnd = random.Random(1)
    make = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    shared = make(230)
    rows = [(i, make(rnd.randrange(80)) + shared[rnd.choice([0, 0, 5, 25]) :] + make(rnd.randrange(80))) for i in range(150)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_most=4).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == _repeats([(d, t.encode()) for d, t in rows])


def test_op2_one_python_operator_a_task(spark, monkeypatch):
    """Each Python operator of a stage holds a worker of its own for each task, and workers stay."""
    rnd = random.Random(1)
    make = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    shared, marked, found = make(230), suffixes._marked, []

    def watched(rows):
        found.append(len(re.findall("MapInArrow", rows._jdf.queryExecution().executedPlan().toString())))
        return marked(rows)

    monkeypatch.setattr(suffixes, "_marked", watched)
    rows = [(i, make(20) + shared + make(20)) for i in range(10)]
    suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_most=2)
    assert found[:2] == [1, 1]


def _lcs(a, b, band=10**9):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + (a[i - 1] == b[j - 1] and abs(i - j) <= band))
    return int(best[-1, -1])


@pytest.mark.parametrize("stride", [4, alignment.STRIDE])
def test_alignment(monkeypatch, stride):
    monkeypatch.setattr(alignment, "STRIDE", stride)
    rnd = random.Random(5)
    for _ in range(400):
        a = [rnd.randrange(rnd.choice([3, 10, 30])) for _ in range(rnd.randrange(25))]
        b = [x for x in a if rnd.random() < 0.9] if rnd.random() < 0.6 else [rnd.randrange(10) for _ in range(rnd.randrange(25))]
        whole = _lcs(a, b)
        assert alignment.kept_words(a, b, 100) == whole
        for band in (0, 2, 5):
            assert _lcs(a, b, band) <= alignment.kept_words(a, b, band) <= whole
        for threshold in (0.5, 0.8, 0.9):
            want = len(a) + len(b) > 0 and whole >= threshold * max(len(a), len(b)) - 1e-9
            assert alignment.alike(np.array(a, np.uint64), np.array(b, np.uint64), threshold) == want


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _closure(rows, enough):
    """Least doc_id of each class of equal texts and of texts that an alignment over all their words finds alike; enough(shared, all) of their shingles must agree."""
    up, first, shingles = {d: d for d, _ in rows}, {}, {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)

    for d, t in sorted(rows):
        join(d, first.setdefault(t or "", d))
        w = _words(t)
        shingles[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    text = dict(rows)
    ids = sorted(set(first.values()))
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(shingles[i] & shingles[j])
            if not both or not enough(both, len(shingles[i] | shingles[j])):
                continue
            a, b = _words(text[i]), _words(text[j])
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and _lcs(a, b) >= 0.8 * max(len(a), len(b)) - 1e-9:
                join(i, j)
    return {d: root(d) for d in up}


def _between(got, rows):
    """All links of half-shared shingles and more are found, and none but true ones."""
    least, most = _closure(rows, lambda both, all_: both >= 0.5 * all_), _closure(rows, lambda *_: True)
    united = collections.defaultdict(set)
    for d, c in got.items():
        united[c].add(d)
    assert all(len({most[d] for d in members}) == 1 and c == min(members) for c, members in united.items())
    assert all(got[d] == got[c] for d, c in least.items())


@pytest.mark.parametrize("part", [3, ordered.PART])
def test_op3(spark, part):
    rnd = random.Random(8)
    rows = []
    for k in range(25):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([4, 5, 30, 120]))]
        for _ in range(rnd.choice([1, 2, 5])):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 2, 5])):
                words[rnd.randrange(len(words))] = f"v{rnd.randrange(9999)}"
            rows.append((len(rows), " ".join(words)))
    got = ordered.classes(spark.createDataFrame(rows, "doc_id long, text string"), part).collect()
    _between({r.doc_id: r.component_id for r in got}, rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op3_edited_texts(spark):
    """Texts of 300 words link when 3, 5 or 10 of 100 words are changed, dropped or added."""
    rnd = random.Random(4)
    rows = []
    for share in (0.03, 0.05, 0.1):
        for k in range(100):
            words = [f"w{rnd.randrange(5000)}" for _ in range(300)]
            other = [x for w in words for x in ([w] if rnd.random() > share else rnd.choice([[], ["new"], [w, "new"]]))]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in ordered.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n in range(3):
        assert sum(got[d + 1] == d for d in range(200 * n, 200 * n + 200, 2)) >= 97
    assert all(got[d] in (d, d - 1) for d in got)


@pytest.mark.parametrize("n", [300, 900])
def test_op3_links_follow_the_group(spark, n, monkeypatch):
    """A group of near copies sends its members' number of links, not their pairs."""
    rnd = random.Random(n)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    rows = [(i, " ".join(w if rnd.random() > 0.03 else f"v{rnd.randrange(9999)}" for w in base)) for i in range(n)]
    sent = []
    original = components.components
    monkeypatch.setattr(components, "components", lambda edges: (sent.append(edges.count()), original(edges))[1])
    got = ordered.classes(spark.createDataFrame(rows, "doc_id long, text string"), 64).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1
    assert sum(sent) <= ordered.TUPLES * n


def test_op3_short_texts(spark):
    rows = []
    for k in range(400):
        words = [f"s{k}.{i}" for i in range(9)]
        rows += [(len(rows), " ".join(words[:8])), (len(rows) + 1, " ".join(words))]
    for k in range(100):  # 8 shared of 10
        words = [f"t{k}.{i}" for i in range(14)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:12]))]
    got = {r.doc_id: r.component_id for r in ordered.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_op3_miss_rate():
    for u in range(ordered.SHORT + 1, 2000):
        miss = lambda share: (1 - math.comb(math.ceil(share * u), ordered.TAKEN) / math.comb(u, ordered.TAKEN)) ** ordered.TUPLES
        assert miss(0.8) < 1e-9 and miss(0.5) < 2e-3 and miss(0.4) < 2e-2


def test_op3_edges(clashing, nothing):
    got = {r.doc_id: r.component_id for r in ordered.classes(clashing).collect()}
    _between({d: c for d, c in got.items() if d is not None}, edge_rows())
    assert None in got and ordered.classes(nothing).count() == 0


def test_op3_rows_without_an_id_of_their_own(spark):
    """Null and repeated doc_ids: every row has its class, and each class keeps one row."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(["x", *words[1:]]), " ".join(f"y{i}" for i in range(60))
    rows = [(7, a), (7, c), (7, c), (None, b), (None, b), (9, c), (None, "alone in the world with no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id or 0, r.kept) for r in ordered.classes(docs).collect())
    assert [x[:2] for x in got] == [(0, 0), (0, 7), (0, 7), (7, 7), (7, 7), (7, 7), (9, 7)]
    assert sum(x[2] for x in got) == 3
    kept = sorted((r.doc_id or 0, r.text) for r in ordered.survivors(docs).collect())
    assert kept == sorted([(0, rows[6][1]), (7, a), (7, c)])


def test_op3_very_long_texts(spark):
    rnd = random.Random(6)
    words = [f"w{rnd.randrange(4000)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(w for w in words if rnd.random() > 0.05)), (3, " ".join(words[:40_000]))]
    got = {r.doc_id: r.component_id for r in ordered.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_small_tables_take_few_files(spark, monkeypatch):
    """Edges that one file holds are not spread over as many files as there are shuffle partitions."""
    written, made = components._written, []

    def watched(*a):
        out = written(*a)
        made.append(out[0].rdd.getNumPartitions())
        return out

    monkeypatch.setattr(components, "_written", watched)
    edges = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = components.components(edges)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.id, r.component) for r in got.collect()} == {(i, 0) for i in range(101)}
    assert set(made[1:]) == {1}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


@pytest.mark.parametrize("tile", [16, 1024])
def test_op5(spark, tile):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(5, 8))
    rows = [(i, (centers[i % 5] + rng.normal(size=8) * 0.25).tolist(), int(i % 3)) for i in range(150)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [1.0, None] + [0.0] * 6, 1), (303, [float("nan")] * 8, 1), (304, [1.0] * 8, None), (305, [1.0] * 8, 2), (306, [1.0] * 8, 2), (309, [], 2), (310, [1.0], 2), (311, [-0.0] * 7 + [1.0], 2), (312, [0.0] * 7 + [1.0], 2), (313, [float("inf")] * 8, 2)]
    fine = [(i, np.array(v, float), x) for i, v, x in rows if x is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    n, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, x, a) in enumerate(fine):
        for j, y, b in fine[k + 1 :]:
            if a == b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                n[i], n[j] = n[i] + 1, n[j] + 1
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    got = vectors.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tile=tile).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n[i], root(i), i == root(i)) for i in n}


def test_op5_tables(spark):
    vectors_ = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert vectors.op5_vectors(spark, SF).count() == vectors_.count()
    assert vectors.classes(vectors_.limit(0)).count() == 0


def test_quantisation_bounds():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(50, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    q, s, n, e = vectors.quantised(unit)
    product = (q.astype(int) @ q.T.astype(int)) * s[:, None] * s[None, :]
    assert (np.abs(unit @ unit.T - product) <= e[:, None] * n[None, :] + (n + e)[:, None] * e[None, :] + 1e-12).all()
