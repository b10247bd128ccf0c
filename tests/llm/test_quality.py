from __future__ import annotations

import collections
import math
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from allelake.llm import classifier, common, licences, notices, rules, scoring

from .conftest import SF, edge_rows


def _measured(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    again = {k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)


def test_op4_measures(clashing, nothing):
    got = {r.doc_id: r for r in rules.judge(clashing, row=True).collect()}
    for i, t in edge_rows():
        r, m = got[i], _measured(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert r.kept == (r.failed & rules.DEFAULT.mask == 0) and r.row.text == t
    assert rules.judge(nothing).count() == 0


def test_op4_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(rules.OP4_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = rules.op4_rules(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns) and (got[want.columns].fillna("") == want.fillna("")).all().all()


def test_op4_forms(spark):
    """Lists, ellipses, words without letters, stop words, and texts that are long and nothing else."""
    prose = "the cat and a dog walked along one green river " * 6
    texts = {"bullets": "- item of the list\n• and another one\n * third\n" * 20, "ellipses": (prose[:40] + "...\n" + prose[:30] + "…  \n" + prose + "\n"), "few_letters": "the and " + "12 34 !! word " * 30, "few_stop_words": "ein zwei drei vier " * 20}
    rows = {i: (n, t) for i, (n, t) in enumerate(texts.items())}
    rows[9] = ("long", " ".join(f"word{i} the and" for i in range(70_000)))
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame([(i, t) for i, (_, t) in rows.items()], "doc_id long, text string")).collect()}
    for i, (name, _) in rows.items():
        assert name == "long" or got[i].failed & rules.BITS[name], name
    assert got[9].kept and got[9].failed == rules.BITS["many_words"] and got[9].only_rule is None
    assert (got[0].n_bullet_lines, got[1].n_ellipsis_lines, got[2].n_letter_words, got[1].n_stop_words) == (60, 2, 32, 2)
    assert got[0].n_lines == 60 and not got[0].kept


def test_ablation(edges):
    rows = rules.ledger(edges)
    got = {r.rule: r for r in rules.ablation(rows).collect()}
    assert set(got) == set(rules.DEFAULT.rules)
    alone = {r.only_rule: r["count"] for r in rules.judge(edges).groupBy("only_rule").count().collect()}
    for rule in got:
        bit = rules.BITS[rule]
        assert got[rule].n_failed == rows.filter(f"failed & {bit} <> 0").count()
        assert got[rule].n_only == rows.filter(f"failed & {rules.DEFAULT.mask} = {bit}").count() == alone.get(rule, 0)


def test_op4_is_native(edges):
    plan = rules.judge(edges)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("RDDScan", ""))


def _model(rows, order, mu):
    end = "</s>"

    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [end]

    counts = [collections.Counter() for _ in range(order)]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    for d, t in rows:
        w = [end, *tokens(t)]
        for i in range(1, len(w)) if not held[d] else ():
            for k in range(1, order + 1):
                if i - k + 1 >= 0:
                    counts[k - 1][tuple(w[i - k + 1 : i + 1])] += 1
    n, v, out = sum(counts[0].values()), len(counts[0]), {}
    for d, t in rows:
        w, base, score, known = [end, *tokens(t)], 0.0, 0.0, 0
        for i in range(1, len(w)):
            c = counts[0][(w[i],)]
            p = (c + 0.5) / (n + 0.5 * (v + 1))
            known, base = known + (c > 0), base + math.log10(p)
            for k in range(2, order + 1):
                if i - k + 1 < 0:
                    break
                h = tuple(w[i - k + 1 : i])
                if counts[k - 2][h]:
                    p = (counts[k - 1][(*h, w[i])] + mu * p) / (counts[k - 2][h] + mu)
            score += math.log10(p)
        out[d] = (held[d], len(w) - 1, known, n, pytest.approx(base, rel=1e-9), pytest.approx(score, rel=1e-9))
    return out


@pytest.mark.parametrize(("order", "mu", "size"), [(2, 100.0, 12 << 20), (2, 10.0, 3000), (3, 20.0, 5000)])
def test_op8(edges, order, mu, size):
    got = scoring.score(edges, order, mu, size).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == _model(edge_rows(), order, mu)


def test_op8_edges(clashing, nothing):
    assert scoring.score(clashing).count() == len(edge_rows()) + 1
    assert scoring.score(nothing).count() == 0


def test_op8_beats_its_base(spark):
    r = scoring.op8_scores(spark, SF).filter("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]


def _licence(t):
    known = [(n, collections.Counter(licences.words(x))) for n, x in licences.TEMPLATES]
    df = collections.Counter(w for _, c in known for w in c)
    weigh = lambda c: {w: k * (math.log((1 + len(known)) / (1 + df[w])) + 1) for w, k in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best = (0.0, None)
    for unit in [*(t or "").split("\n"), t or ""]:
        v = weigh(collections.Counter(licences.words(unit)))
        for name, c in known:
            x = weigh(c)
            s = sum(v[w] * x[w] for w in v if w in x) / (norm(v) * norm(x)) if v else 0
            if s >= licences.THRESHOLD - 1e-12 and s > best[0] + 1e-12:
                best = (s, name)
    return best[1]


def test_op6(spark, clashing, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.own for r in licences.op6_licences(spark, SF).collect()}
    assert got == {r.doc_id: _licence(r.text) for r in docs.collect()} and any(got.values())
    path = F.lit(None).cast("string").alias("path")
    assert licences.scan(clashing.withColumn("path", path)).count() == clashing.count()
    assert licences.scan(nothing.withColumn("path", path)).count() == 0


def test_op6_inheritance(spark):
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.c", "int x"), (3, "a/b/c/y", None), (4, "z/q", "hello"), (5, "a/b/COPYING", "Licensed under CC BY-NC 4.0."), (6, "ab/x", "nothing")]
    rows = {r.doc_id: (r.licence, r.origin) for r in licences.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert rows == {1: ("MIT", "a/LICENSE"), 2: ("CC-BY-NC-4.0", "a/b"), 3: ("CC-BY-NC-4.0", "a/b"), 4: (None, None), 5: ("CC-BY-NC-4.0", "a/b/COPYING"), 6: (None, None)}


def test_op6_texts_and_headers(spark):
    full = dict(notices.TEXTS)
    own = lambda name: full[name].replace("<year>", "2019").replace("<copyright holders>", "Ann Example and others").replace("<copyright holder>", "Ann Example")
    gpl = textwrap.wrap(dict(notices.HEADERS)["GPL-3.0"].replace("library", "program"), 60)
    bullets = re.sub(r"(?m)^\d\. ", "* ", "\n".join(textwrap.fill(x, 70) for x in own("BSD-3-Clause").split("\n"))).replace('"AS IS"', "``AS IS''")
    files = [(f"{n}/LICENSE", own(n), n) for n in full]
    files += [
        ("w/LICENSE", bullets, "BSD-3-Clause"),
        ("readme/README.md", "# Thing\n\nIt counts apples and pears in a basket.\n\n" * 3 + "## License\n\n" + textwrap.fill(own("ISC"), 60, replace_whitespace=False), "ISC"),
        ("c/x.c", "/*\n * x.c: counts apples\n *\n" + "".join(f" * {x}\n" for x in gpl) + " */\n#include <stdio.h>\nint main() { return 0; }\n" * 3, "GPL-3.0"),
        ("s/x.py", "#!/usr/bin/python\n# SPDX-License-Identifier: GPL-2.0-or-later\nimport os\nprint(os.name)\n", "GPL-2.0"),
        ("n/a", "The license of the driver was lost and found in the park, and the notice was returned without warranty of any kind.", None),
        ("n/b", "mit\nMIT\nder mit und mit", None),
    ]
    rows = [(i, p, t) for i, (p, t, _) in enumerate(files)]
    got = {r.path: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {p: got[p].own for p, _, _ in files} == {p: n for p, _, n in files}
    assert all(got[f"{n}/LICENSE"].is_file for n in full) and not got["s/x.py"].is_file


def test_op7_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("out", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(5)) == 0)
    rows = classifier.op7_classifier(spark, sf).join(labels.filter("out"), "doc_id").toPandas()
    good = (rows.quality == 1) & (rows.toxic == 0)
    assert rows.kept[good].mean() >= 0.95 and rows.kept[rows.quality == 0].mean() <= 0.2


def test_op7_exchange(spark):
    """Pages tell texts: a word that labels say nothing about turns good when it stands on pages of a good source."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    rows, marks = [], []
    for i in range(400):  # the source alone tells labelled documents apart
        good = i % 2
        rows.append((i, " ".join([*rnd.sample(words, 6), rnd.choice(["apple", "pear"])]), "en", "a" if good else "b", 50))
        marks.append((i, good, 0))
    for i in range(400, 1200):
        good = i % 2
        rows.append((i, " ".join([*rnd.sample(words, 6), "apple" if good else "pear"]), "en", "a" if good else "b", 50))
    rows.append((None, None, None, None, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    before, after = classifier.fit(docs, labels, rounds=0), classifier.fit(docs, labels, rounds=2)

    def weight(model, word):
        hashes, counts, _ = classifier.text_features([word.encode()])
        at = int(np.searchsorted(model["words"], hashes[0]))
        assert model["words"][at] == hashes[0] and counts.tolist() == [1]
        return model["text_sparse"][at]

    gap = lambda m: weight(m, "apple") - weight(m, "pear")
    assert gap(after) > gap(before) + 0.2

    # What the pages tell, feature by feature, against a plain count.
    told, page_told = classifier._exchange(docs.filter("doc_id >= 400 or doc_id is null"), before)
    sure = {}
    for d, t, lang, source, n in rows[400:]:
        _, p, _ = classifier.predict(before | {"numbers": np.array([*before["numbers"][:2], 1, 0, 1, 0, 0, 1, 0])}, [(t or "").encode()], [lang], [source], [n])
        known = [w for w in (t or "").split() if np.isin(classifier.text_features([w.encode()])[0], before["words"]).all()]
        for k, yes in enumerate((p[0] >= classifier.SURE, p[0] <= 1 - classifier.SURE)):
            for w in known if yes else ():
                sure[k, w] = sure.get((k, w), 0) + classifier.WHOLE // len(known)
    place = lambda w: int(np.searchsorted(before["words"], classifier.text_features([w.encode()])[0][0]))
    assert sure and {(k, place(w)): n for (k, w), n in sure.items()} == {(k, i): int(n) for k in (0, 1) for i, n in enumerate(told[k]) if n}
    assert page_told.shape[1] == len(before["pages"])


def test_op7_edges(spark, clashing, nothing):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, None), (9, 0, 0), (10, 0, 0), (None, 1, 0), (11, None, 1)], "doc_id long, quality int, toxic int")
    assert classifier.classify(clashing, labels).count() == clashing.count()
    unlabelled = classifier.classify(clashing, labels.limit(0)).collect()
    assert all(r.kept and r.score is None for r in unlabelled) and len(unlabelled) == clashing.count()
    assert classifier.classify(nothing, labels).count() == 0


def test_hashes_of_spans_keep_no_large_tables():
    """Hashes are the polynomial's, and a worker that has hashed a large text holds no tables of its size."""
    raw = np.random.default_rng(4).integers(0, 256, 3_000_000).astype(np.uint8)
    starts = np.array([0, 1, 1023, 1024, 1025, 70_000, 2_999_990])
    ends = starts + [9, 0, 5, 2000, 3, 40, 10]
    codes, modulus = common.byte_codes(3).tolist(), 1 << 64
    sums = [sum(codes[x] * pow(common._MULTIPLIER, k, modulus) for k, x in enumerate(raw[a:b].tolist())) % modulus for a, b in zip(starts, ends)]
    want = common.mixed(np.array(sums, np.uint64) ^ common.mixed((ends - starts).astype(np.uint64) + np.uint64(4)))
    assert common.span_hashes(raw, starts, ends, 3).tolist() == want.tolist()
    assert sum(x.nbytes for x in common._TABLES.values()) < 1 << 16


def test_values_laid_out():
    """Bytes of sliced and empty chunks, one behind the other."""
    values = [np.arange(k, dtype=np.uint64).tobytes() for k in range(6)]
    column = pa.chunked_array([pa.array(values, pa.binary()).slice(2, 3), pa.array([], pa.binary()), pa.array(values, pa.binary())])
    assert classifier._laid_out(column, np.uint64).tolist() == np.frombuffer(b"".join(values[2:5] + values), np.uint64).tolist()
