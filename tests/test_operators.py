from __future__ import annotations

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from allelake.functions import inheritance
from allelake.functions import variant as V
from allelake.operators import families, overlap, records, samples, stats
from allelake.plans import facets, filters, index, projection
from allelake.plans import language as L
from allelake.sources import tabular, vcf
from allelake.streaming import pending


@pytest.mark.parametrize("op", ["=", "!=", "<", "<=", ">", ">=", "<<", "<<=", ">>", ">>="])
def test_null_semantics(spark, op):
    rows = spark.createDataFrame([(1.0,), (5.0,), (9.0,), (None,)], "x double")
    got = [r[0] for r in rows.select(V.compare(F.col("x"), op, 5.0)).collect()]
    plain = {"=": (0, 1, 0), "!=": (1, 0, 1), "<": (1, 0, 0), "<=": (1, 1, 0), ">": (0, 0, 1), ">=": (0, 1, 1)}[op[:2].replace("<<", "<").replace(">>", ">") + op[2:] if op not in ("!=", "<=", ">=") else op]
    assert got == [*map(bool, plain), op == "!=" or op[:2] in ("<<", ">>")]


def test_row_semantics(spark):
    rows = spark.createDataFrame([("1.5",), ("abc",), (None,)], "x string")
    got = lambda op, v: [r[0] for r in rows.select(V.row_compare(F.try_to_number("x", F.lit("9.9")) if op == ">" else F.col("x"), op, v)).collect()]
    assert got("!=", "abc") == [True, False, False] and got("=~", "^a") == [False, True, False] and got(">", "1") == [True, False, False]


def test_genotypes(spark):
    want = {"0/0": "HOM_REF", "0|0": "HOM_REF", "1/1": "HOM_ALT", "0/1": "HET_REF", "1|2": "HET_ALT", "./.": "MISS", "./1": "HET_MISS", "NA": "NA", None: "NA", "1": "HOM_ALT"}
    rows = spark.createDataFrame([(g,) for g in want], "gt string")
    assert {r.gt: r.c for r in rows.select("gt", V.genotype_class(F.col("gt")).alias("c")).collect()} == want
    assert rows.filter("gt = '1|2'").select(V.unphased(F.col("gt"))).first()[0] == "1/2"


def test_trimming(spark):
    cases = [(10, "AT", "A", (11, "T", "")), (10, "CAT", "CGT", (11, "A", "G")), (10, "A", "AC", (11, "", "C")), (10, "TT", "T", (10, "T", "")), (10, "A", "C", (10, "A", "C"))]
    rows = spark.createDataFrame([c[:3] for c in cases], "p long, r string, a string")
    got = [tuple(r.t) for r in rows.select(V.trimmed(F.col("p"), F.col("r"), F.col("a")).alias("t")).collect()]
    assert got == [c[3] for c in cases]


def _intervals(n, seed):
    rnd = random.Random(seed)
    return [(i, rnd.choice("12"), s := rnd.randrange(1, 300), s + rnd.choice([0, 3, 50])) for i in range(n)]


@pytest.mark.parametrize("width", [1, 16, 1 << 14])
def test_overlaps(spark, width):
    a, b = _intervals(60, 1), _intervals(40, 2)
    frame = lambda r: spark.createDataFrame(r, "id long, chrom string, start long, end long")
    got = sorted((r.id, r.r_id) for r in overlap.overlaps(frame(a), frame(b), width).collect())
    assert got == sorted((x[0], y[0]) for x, y in itertools.product(a, b) if x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2])
    want = {(c, p) for _, c, s, e in a for p in range(s, e + 1)} & {(c, p) for _, c, s, e in b for p in range(s, e + 1)}
    assert {(r.chrom, p) for r in overlap.common(frame(a), frame(b)).collect() for p in range(r.start, r.end + 1)} == want


@pytest.mark.parametrize("width", [7, 64, 1 << 14])
def test_merged_and_nearby(spark, width):
    rows = _intervals(80, 4)
    frame = spark.createDataFrame(rows, "id long, chrom string, start long, end long")
    want = []
    for chrom in "12":
        for s, e in sorted((s, e) for _, c, s, e in rows if c == chrom):
            if want and want[-1][0] == chrom and s <= want[-1][2] + 1:
                want[-1] = (chrom, want[-1][1], max(want[-1][2], e), want[-1][3] + 1)
            else:
                want.append((chrom, s, e, 1))
    assert sorted(tuple(r) for r in overlap.merged(frame, width=width).select("chrom", "start", "end", "n").collect()) == want
    near = {r.id: r.n_near for r in overlap.nearby(frame, 20, "chrom", width=width).collect()}
    assert near == {i: sum(c == d and abs(s - t) <= 20 for _, d, t, _ in rows) - 1 for i, c, s, _ in rows}


def test_mendelian_codes(spark):
    """The published table, and absent parents, several alternates, missing genotypes and haploid calls."""
    cases = [  # chromosome, father, mother, child, code
        ("1", "1/1", "1/1", "0/1", 1), ("1", "0/0", "0/0", "0/1", 2), ("1", "0/0", "0/1", "1/1", 3), ("1", "1|0", "0|0", "1|1", 4),
        ("1", "0/0", "0/0", "1/1", 5), ("1", "1/1", "0/1", "0/0", 6), ("1", "0/0", "1/1", "0/0", 7), ("1", "1/1", "1/1", "0/0", 8),
        ("X", "1", "1/1", "0", 9), ("MT", "0/0", "1/1", "0/0", 9), ("X", "1", "0/0", "1", 10), ("MT", "1", "0", "1", 10),
        ("Y", "1", None, "0", 11), ("Y", "0", None, "1", 12), ("Y", "1", "0/0", "1", 0), ("X", "0", "0/1", "1", 0),
        ("1", "0/0", "0/1", "0/1", 0), ("1", None, "0/0", "1/1", 4), ("1", "0/0", None, "1/1", 3), ("1", None, "0/1", "1/1", 0), ("1", None, "1/1", "0/0", 7), ("1", None, "0/0", "0/1", 0),
        ("1", "0/0", "1/1", "2/3", 2), ("1", "0/1", "1/0", "2/2", 5), ("1", "0/1", "0/2", "1/2", 0), ("1", "1/1", "1/2", "0/2", 1),
        ("1", "0/1", "0/1", "./.", None), ("1", "./.", "0/0", "1/1", None), ("1", "0/0", "0/0", None, None), ("X", "0", "0/0", "0", 0),
    ]
    rows = spark.createDataFrame(cases, "chrom string, f string, m string, c string, want int")
    for r in rows.select("*", inheritance.mendelian_error(F.col("c"), F.col("f"), F.col("m"), F.col("chrom")).alias("code")).collect():
        assert r.code == r.want, r


def test_modes_of_inheritance(spark):
    cases = [("X", "1", "0", "0/1", "xLinkedRecessive"), ("X", "0/1", "1", "0/0", "xLinkedDominant"), ("Y", "1", "1", None, "yLinked"), ("MT", "1/1", "0/0", "1/1", "mitochondrial"), ("2", "1/1", "0/1", "0/1", "autosomalRecessive"), ("2", "0/1", "0/0", "0/1", "autosomalDominant")]
    rows = spark.createDataFrame([(str(i), *c) for i, c in enumerate(cases)], "trio string, chrom string, child string, father string, mother string, want string")
    got = {(r.trio, r.mode) for r in families.by_modes(rows, tuple(m for m in inheritance.MODES if m not in ("deNovo", "deNovoStrict", "mendelianError"))).collect()}
    assert got == {*((str(i), c[-1]) for i, c in enumerate(cases)), ("0", "xLinkedDominant")}  # a carrier's son fits both
    assert inheritance.mode_name("X_LINKED_RECESSIVE") == "xLinkedRecessive" and inheritance.mode_name("DE_NOVO") == "deNovo"


def test_knockouts_need_both_parents_alleles(spark):
    """Two heterozygous variants from one parent are no pair."""
    calls = spark.createDataFrame([(1, 0, "0/1"), (1, 1, "0/1"), (2, 0, "0/1"), (2, 1, "0/1"), (3, 0, "0/1"), (3, 2, "0/1"), (4, 9, "0/1"), (5, 9, "0/1"), (6, 9, "1/1")], "key long, sample long, gt string")
    cts = spark.createDataFrame([(k, g, "stop_gained") for k, g in ((1, "A"), (2, "A"), (3, "A"), (1, "B"), (2, "B"), (4, "A"), (5, "A"), (6, "A"))], "key long, gene string, term string")
    trios = spark.createDataFrame([("t", 0, 1, 2)], "trio string, child long, father long, mother long")
    got = {tuple(r) for r in families.knockouts(calls, cts, ("stop_gained",), trios).select("sample", "gene", "hom_alt", "het_alt", "comp_het").collect()}
    assert got == {(0, "A", 0, 0, 2), (9, "A", 1, 0, 0)}


def test_fisher(spark):
    tables = [(8, 2, 1, 5), (10, 10, 0, 0), (3, 3, 3, 3), (0, 12, 9, 1)]
    rows = spark.createDataFrame(tables, "case_ref long, control_ref long, case_alt long, control_alt long")
    got = {tuple(r)[:4]: r.p_value for r in stats.fisher(rows).select("case_ref", "control_ref", "case_alt", "control_alt", "p_value").collect()}
    for a, b, c, d in tables:
        n, row, col = a + b + c + d, a + b, a + c
        term = lambda k: math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col)
        want = sum(term(k) for k in range(max(0, row + col - n), min(row, col) + 1) if term(k) <= term(a) * (1 + 1e-7))
        assert got[a, b, c, d] == pytest.approx(want, rel=1e-9)


def test_sets(spark):
    pairs = spark.createDataFrame([(s, k) for s in range(4) for k in range(s, 6)], "sample long, key long")
    wanted = spark.createDataFrame([(0,), (1,), (1,)], "key long")
    assert [r[0] for r in samples.in_all(pairs, wanted, "sample").collect()] == [0]
    everyone = pairs.select("sample").distinct()
    tree = ("and", everyone, ("not", pairs.filter("key = 1")))
    assert sorted(r[0] for r in samples.eligible(tree, everyone).collect()) == [2, 3]


def test_gaps(spark):
    v = spark.createDataFrame([(1, "1", 100, 100), (2, "1", 500, 500), (3, "1", 900, 900)], "key long, chrom string, start long, end long")
    calls = spark.createDataFrame([(1, 0)], "key long, sample long")
    archive = spark.createDataFrame([(0, "1", 450, 550, True, "0/0"), (1, "1", 100, 101, False, "0/1"), (1, "1", 500, 500, False, "1/1"), (1, "1", 499, 501, False, "0/1")], "sample long, chrom string, start long, end long, is_reference boolean, gt string")
    got = {(r.key, r.sample): (r.status, r.gt) for r in records.fill_gaps(v, spark.range(2).withColumnRenamed("id", "sample"), calls, archive).collect()}
    assert got == {(1, 1): ("VARIANT", "0/2"), (2, 0): ("REFERENCE", "0/0"), (2, 1): ("MULTI", "2/2"), (3, 0): ("GAP", "./."), (3, 1): ("GAP", "./.")}


def test_gaps_by_brute_force(spark):
    """Long, empty and equal intervals, edges of bins, several reference genotypes, nulls: what SQL's joins would say."""
    rng = random.Random(5)
    at = lambda: rng.choice((0, overlap.BIN, 2 * overlap.BIN)) + rng.randrange(-6, 7)
    size = lambda: rng.choice((-1, 0, 0, 1, 2, 5, overlap.BIN, 3 * overlap.BIN))
    v = [(k, rng.choice("12"), s, s + size()) for k in range(150) for s in (at(),)] + [(150, None, 1, 1), (151, "1", None, 1), (152, "1", 1, None), (None, "1", 1, 1)]
    calls = [(rng.randrange(150), rng.randrange(3)) for _ in range(60)]
    archive = [(rng.choice((0, 1, 3)), rng.choice("12"), s, s + size(), rng.random() < 0.4, rng.choice(("0/0", "0|0", "./.", "0/1", "1/1", None))) for _ in range(45) for s in (at(),)]
    archive += [(None, "1", 0, 9, True, "0/0"), (0, None, 0, 9, True, "0/0"), (0, "1", 0, 9, None, "0/0")]
    frames = [spark.createDataFrame(rows, ddl) for rows, ddl in ((v, "key long, chrom string, start long, end long"), (calls, "key long, sample long"), (archive, "sample long, chrom string, start long, end long, is_reference boolean, gt string"))]
    want = []
    for key, chrom, s, e in v:
        for sample in set(range(3)) - {b for a, b in calls if a == key}:
            met = [x for x in archive if None not in (chrom, s, e, x[4]) and x[:2] == (sample, chrom) and x[2] <= e and x[3] >= s]
            other, ref = [x[5] for x in met if not x[4]], min((x[5] for x in met if x[4] and x[5]), default=None)
            status = "MULTI" if len(other) > 1 else "VARIANT" if other else "REFERENCE" if ref else "GAP"
            want.append((key, sample, status, {"MULTI": "2/2", "VARIANT": other[0].replace("1", "2") if other and other[0] else None, "REFERENCE": ref, "GAP": "./."}[status]))
    got = records.fill_gaps(frames[0], spark.range(3).withColumnRenamed("id", "sample"), frames[1], frames[2])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert len({w[2] for w in want}) == 4


def test_gaps_make_no_row_a_pair(spark):
    """Thousands of intervals upon one place: rows between steps stay as few as variants and intervals."""
    v = spark.range(1500).selectExpr("id AS key", "'1' AS chrom", "100 + id % 3 AS start", "101 + id % 3 AS end")
    archive = spark.range(3000).selectExpr("id % 2 AS sample", "'1' AS chrom", "90 + id % 5 AS start", "id % 7 + 105 AS end", "id % 3 = 0 AS is_reference", "'0/0' AS gt")
    got = records.fill_gaps(v, spark.range(2).withColumnRenamed("id", "sample"), v.selectExpr("key", "0L AS sample").filter("key < 0"), archive)
    assert {tuple(r) for r in got.groupBy("status").count().collect()} == {("MULTI", 3000)}
    assert not re.search("Join.*bin", got._jdf.queryExecution().executedPlan().toString())


def test_out_of_sync(spark):
    """Repeated keys once, keys with a null on either side; neither side is sorted or joined."""
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (3, None), (3, None), (5, "y")], "k long, s string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "x"), (4, "x"), (5, "y")], "k long, s string")
    got = records.out_of_sync(a, b, ["k", "s"])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [(2, "x", "b"), (2, "y", "a"), (3, None, "a"), (3, None, "b"), (4, "x", "a")]))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


LINES = ["##fileformat=VCFv4.2", "#CHROM\tPOS", "chr1\t10\trs1\tA\tC,AT\t50\tPASS\tDP=3;DB\tGT:DP\t0/1:7\t1|2", "1\tx\t.\tA\tC\t.\t.\t.", "short", "2\t20\t.\tAT\tA\t.\tq10;s50\t.\tGT\t./.\t0/0"]


def test_vcf(spark, tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text("\n".join(LINES) + "\n")
    lines = spark.read.text(str(path))
    rows = vcf.records(lines)
    assert vcf.records(lines, keep_malformed=True).count() == 2
    first, second = rows.orderBy("chrom").collect()
    assert (first.chrom, first.pos, first.id, first.qual, first.filter, first.info) == ("1", 10, "rs1", 50.0, ["PASS"], {"DP": "3", "DB": "true"})
    assert second.qual is None and second.filter == ["q10", "s50"]
    assert sorted((r.start, r.reference, r.alternate) for r in vcf.biallelic(rows).collect()) == [(10, "A", "C"), (11, "", "T"), (21, "T", "")]
    data = {(r.chrom, r.sample): r.data for r in vcf.calls(rows, ["x", "y"]).collect()}
    assert data["1", "x"] == {"GT": "0/1", "DP": "7"} and data["1", "y"] == {"GT": "1|2"}


def test_tracks(spark, tmp_path):
    bed = tmp_path / "t.bed"
    bed.write_text("#c\n1\t9\t20\tfirst\t0\t+\n")
    rows = tabular.track(spark, str(bed)).collect()
    assert (rows[0].start, rows[0].end, rows[0].name) == (10, 20, "first")
    with pytest.raises(ValueError):
        tabular.track(spark, "x.txt")
    tsv = tmp_path / "s.tsv"
    tsv.write_text("#id\trs1\n1:2:A:C\t0.5\tx\n")
    assert tabular.scores(spark, str(tsv), {"id": 0, "score": 1, "p_value": 2}).collect()[0] == ("1:2:A:C", 0.5, None)


def test_unknown_parameters():
    for bad in ({"colour": "red"}, {"type": "SNV,!MNV"}, {"transcriptFlag": "shiny"}):
        with pytest.raises(L.LanguageError):
            filters.condition(bad)


def test_ranges(spark):
    rows = spark.createDataFrame([(x,) for x in (None, 5.0, 10.0, 25.0)], "x double")
    assert [r[0] for r in rows.select(facets.range_label(F.col("x"), [10, 20])).collect()] == ["NA", "(-inf, 10)", "[10, 20)", "[20, inf)"]
    assert [r[0] for r in rows.select(facets.range_label(F.col("x"), [10, 20], True)).collect()] == ["NA", "(-inf, 10]", "(-inf, 10]", "(20, inf)"]


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:01:00"), (1, "2024-01-01 00:02:00")], "id long, t string").withColumn("t", F.to_timestamp("t"))
    rows.coalesce(1).write.parquet(source)
    stream = pending.arriving(spark, source, rows.schema)
    q = pending.settle(stream, "id", "t", "1 hour", str(tmp_path / "out"), str(tmp_path / "check"), lambda b: b.withColumn("done", F.lit(True)))
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    assert pending.windows(rows, "t", "1 minute", "5 minutes", "id").count() == 3


def test_engine(spark):
    from allelake import lens
    from allelake.engine import Engine, project

    sf = "/root/testdata/sf0.001"
    e = Engine(lambda parts: lens.wide(spark, sf, parts), lens.calls(spark, sf), lens.members(spark))
    snv = lens.variants(spark, sf).filter("type = 'SNV'")
    assert e.count({"type": "SNV"}) == snv.count()
    assert [r.key for r in e.query({"type": "SNV"}, include=("key",), limit=5).collect()] == [r.key for r in snv.orderBy(V.chrom_order("chrom"), "start", "end", "reference", "alternate", "key").limit(5).collect()]
    estimate, n = e.approximate_count({"type": "SNV", "release": "2"}, {"type": "SNV"}, sample=100_000)
    assert (estimate, n) == (snv.filter("release <= 2").count(), snv.count())
    assert e.facet({"type": "SNV"}, "chromosome;type>>genotype")["chromosome"].agg(F.sum("n")).first()[0] == snv.count()
    assert "gene" not in project(lens.wide(spark, sf, ("cts",)), exclude=("cts.gene",)).schema["cts"].dataType.elementType.names
    with pytest.raises(L.LanguageError):
        e.query({}, limit=5001)


def test_genotype_codes(spark):
    cases = [("0/0", 0), ("0/1", 1), ("1/1", 2), ("0|0", 3), ("0|1", 4), ("1|0", 5), ("1|1", 6), ("0", 7), ("1", 8), ("2/2", 9), ("1/2", 10), ("0/2", 10), ("./.", 11), ("./1", 12), (None, 13), ("?/?", 13)]
    rows = spark.createDataFrame(cases, "gt string, want int").select("*", V.genotype_code(F.col("gt")).alias("code")).collect()
    assert all(r.code == r.want for r in rows)
    several = [(["0/1"], 1), (["0/1", "1/1"], 14), (["0|1", "1|1", "0|1"], 14), (["0/0", "0/1"], 15), (["0/1", "1/2"], 15)]
    rows = spark.createDataFrame(several, "gts array<string>, want int").select("*", V.genotypes_code(F.col("gts")).alias("code")).collect()
    assert all(r.code == r.want for r in rows)


def test_genotype_classes(spark):
    cases = {"0/2": {"HET", "HET_REF", "SEC"}, "2/2": {"HOM_ALT", "SEC", "SEC_ALT"}, "1/2": {"HET", "HET_ALT", "MAIN_ALT"}, "./1": {"HET", "HET_MISS", "MAIN_ALT"}, "./.": {"MISS"}, "NA": {"NA"}, "1": {"HOM_ALT", "MAIN_ALT"}, "0|0": {"HOM_REF"}}
    rows = spark.createDataFrame([(g,) for g in cases], "gt string").select("gt", *(V.is_class(F.col("gt"), c).alias(c) for c in V.CLASSES)).collect()
    for r in rows:
        assert {c for c in V.CLASSES if r[c]} == cases[r.gt], r.gt


def test_left_aligned(spark):
    """The bases move left as long as the base before them is their last one."""
    rnd, rows = random.Random(2), []
    for _ in range(200):
        context, bases = "".join(rnd.choices("AC", k=rnd.randrange(12))), "".join(rnd.choices("AC", k=rnd.randrange(1, 5)))
        at, moved = len(context), bases
        while at and context[at - 1] == moved[-1]:
            at, moved = at - 1, moved[-1] + moved[:-1]
        rows.append((context, bases, at, moved))
    frame = spark.createDataFrame(rows, "context string, bases string, at int, moved string")
    for r in frame.select("*", V.left_aligned(F.length("context"), F.col("context"), F.col("bases")).alias("t")).collect():
        assert (r.t.start, r.t.sequence) == (r.at, r.moved), r


def test_index_filters(spark):
    """Whatever the comparison, codes and look-ups together find what the values say."""
    rnd = random.Random(3)
    rows = [(k, s, "0/1", rnd.choice([None, *range(0, 60, 3)]), float(rnd.choice([5, 10, 12.5, 20, 25, 30, 35])), rnd.choice([["PASS"], ["LowQ"], ["PASS", "LowQ"], []])) for k in range(40) for s in range(3)]
    calls = spark.createDataFrame(rows, "key long, sample long, gt string, dp int, qual double, filter array<string>")
    built = index.build(calls)
    for text, test in {
        "dp>=15": lambda r: r[3] is not None and r[3] >= 15, "dp>17": lambda r: r[3] is not None and r[3] > 17, "dp<=30": lambda r: r[3] is not None and r[3] <= 30, "dp<10": lambda r: r[3] is not None and r[3] < 10, "dp=30": lambda r: r[3] == 30,
        "qual>30": lambda r: r[4] > 30, "qual<20,filter=LowQ": lambda r: r[4] < 20 or "LowQ" in r[5], "filter!=PASS;qual>=10": lambda r: "PASS" not in r[5] and r[4] >= 10,
    }.items():
        assert {(r.key, r.sample) for r in index.select(built, calls, text).collect()} == {r[:2] for r in rows if test(r)}, text


def test_merge_alleles(spark):
    rows = [("1", 5, "A", "C", 1, "0/1"), ("1", 5, "A", "G", 2, "1|1"), ("1", 5, "A", "G", 3, "1/2"), ("1", 9, "T", "C", 1, "./1"), ("1", 9, "T", "C", 2, "1")]
    got = {(r.start, r.sample): (r.alternates, r.gt) for r in records.merge_alleles(spark.createDataFrame(rows, "chrom string, start int, reference string, alternate string, sample int, gt string")).collect()}
    assert got == {(5, 1): (["C", "G"], "0/1"), (5, 2): (["C", "G"], "2|2"), (5, 3): (["C", "G"], "2/3"), (9, 1): (["C"], "./1"), (9, 2): (["C"], "1")}


def test_include_lists():
    assert projection.included(None, ("a",)) == ("a",) and projection.included("all") is None and projection.included("none") == () and projection.included("x,y") == ("x", "y")
    assert projection.filtered_samples({"sample": "s1;!s2", "genotype": "s3:0/1,1/1"}) == ("s1", "s2", "s3") and projection.filtered_samples({}) is None
    with pytest.raises(L.LanguageError):
        projection.included("all,x")
