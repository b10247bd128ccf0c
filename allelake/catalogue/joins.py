"""Joins of sets, intervals, mates and families."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lens
from ..functions import variant as V
from ..operators import families, overlap, records, samples
from ..plans import filters

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_ALT = "list_contains(string_split_regex({}, '[/|]'), '1')"
_CARRIED = "SELECT key, sample FROM calls WHERE " + _ALT.format("gt")


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _carried(spark, sf_dir):
    return lens.calls(spark, sf_dir).filter(V.carries(F.col("gt")))


def _panel(spark):
    return spark.range(40).selectExpr("concat('panel', id) AS name", "CAST(id % 22 + 1 AS STRING) AS chrom", "(id * 23456) % 900000 + 1 AS start", "(id * 23456) % 900000 + 20000 AS end")


_PANEL = "panel AS (SELECT 'panel' || range AS name, CAST(range % 22 + 1 AS VARCHAR) AS chrom, (range * 23456) % 900000 + 1 AS start, (range * 23456) % 900000 + 20000 AS \"end\" FROM range(40))"


@_add(lens.SQL + f", c AS ({_CARRIED}) SELECT DISTINCT key FROM c WHERE sample = 1 AND key IN (SELECT key FROM c WHERE sample = 2) AND key NOT IN (SELECT key FROM c WHERE sample = 3)")
def j03_sample_intersect(spark, sf_dir):
    c = _carried(spark, sf_dir)
    return samples.all_of([c.filter("sample = 1"), c.filter("sample = 2")], [c.filter("sample = 3")])


@_add(lens.SQL + f", c AS ({_CARRIED}) SELECT DISTINCT key FROM c WHERE sample IN (4, 5, 6)")
def j04_sample_union(spark, sf_dir):
    c = _carried(spark, sf_dir)
    return samples.any_of([c.filter(f"sample = {s}") for s in (4, 5, 6)])


@_add(lens.SQL + "SELECT c.key, sample, gt, dp FROM calls c WHERE key IN (SELECT key FROM variants WHERE type = 'SNV' AND cadd > 30)")
def j01_index_intersect(spark, sf_dir):
    hits = lens.variants(spark, sf_dir).filter(filters.condition({"type": "SNV", "functionalScore": "cadd_scaled>30"}))
    return lens.calls(spark, sf_dir).join(hits.select("key"), "key", "left_semi").select("key", "sample", "gt", "dp")


@_add(lens.SQL + f", {_PANEL} SELECT v.key, p.name FROM variants v JOIN panel p ON v.chrom = p.chrom AND v.start <= p.\"end\" AND v.\"end\" >= p.start")
def j08_overlap(spark, sf_dir):
    return overlap.overlaps(lens.variants(spark, sf_dir).select("key", "chrom", "start", "end"), _panel(spark)).select("key", F.col("r_name").alias("name"))


@_add(lens.SQL + ", w AS (SELECT key, chrom, start, start + key % 9000 AS \"end\" FROM variants), " + _PANEL + " SELECT w.key, p.name, round(100.0 * (least(w.\"end\", p.\"end\") - greatest(w.start, p.start) + 1) / (p.\"end\" - p.start + 1), 6) AS percent FROM w JOIN panel p ON w.chrom = p.chrom AND w.start <= p.\"end\" AND w.\"end\" >= p.start WHERE 100.0 * (least(w.\"end\", p.\"end\") - greatest(w.start, p.start) + 1) / (p.\"end\" - p.start + 1) >= 20")
def j09_overlap_percent(spark, sf_dir):
    rows = lens.variants(spark, sf_dir).select("key", "chrom", "start", (F.col("start") + F.col("key") % 9000).alias("end"))
    return overlap.shared_percent(overlap.overlaps(rows, _panel(spark))).filter("percent >= 20").select("key", F.col("r_name").alias("name"), F.round("percent", 6).alias("percent"))


@_add(lens.SQL + ", e AS (SELECT key AS id, key + CASE WHEN key % 2 = 0 THEN 1 ELSE -1 END AS mate, chrom, start FROM variants), m AS (SELECT a.id, a.mate, a.chrom, a.start, b.chrom AS mate_chrom, b.start + a.id % 80 - 40 AS mate_start FROM e a JOIN e b ON b.id = a.mate) SELECT a.id, b.id AS mate_id, a.chrom, a.start, b.chrom AS mate_chrom, b.start AS mate_start FROM m a JOIN m b ON a.mate = b.id AND b.mate = a.id AND a.mate_chrom = b.chrom AND abs(b.start - a.mate_start) <= 30 WHERE (lpad(a.chrom, 2, '0'), a.start, a.id) < (lpad(b.chrom, 2, '0'), b.start, b.id)")
def j10_breakend_mates(spark, sf_dir):
    e = lens.variants(spark, sf_dir).selectExpr("key AS id", "key + CASE WHEN key % 2 = 0 THEN 1 ELSE -1 END AS mate", "chrom", "start")
    b = e.selectExpr("id AS mate", "chrom AS mate_chrom", "start AS b_start")
    return records.mates(e.join(b, "mate").selectExpr("id", "mate", "chrom", "start", "mate_chrom", "b_start + id % 80 - 40 AS mate_start"), 30)


_TRIO = ", r AS (SELECT trio, unnest(['child', 'father', 'mother']) AS role, unnest([child, father, mother]) AS sample FROM trios), t AS (SELECT key, trio, coalesce(max(CASE WHEN role = 'child' THEN gt END), '0/0') AS child, coalesce(max(CASE WHEN role = 'father' THEN gt END), '0/0') AS father, coalesce(max(CASE WHEN role = 'mother' THEN gt END), '0/0') AS mother FROM calls JOIN r USING (sample) GROUP BY 1, 2)"


def _trios(spark, sf_dir):
    return families.trio_genotypes(lens.calls(spark, sf_dir), lens.trios(spark))


@_add(lens.SQL + _TRIO + " SELECT * FROM t")
def j12_trio_genotypes(spark, sf_dir):
    return _trios(spark, sf_dir)


_CODES = ", a AS (SELECT *, string_split_regex(child, '[/|]') AS c, string_split_regex(father, '[/|]') AS f, string_split_regex(mother, '[/|]') AS m FROM t), l AS (SELECT *, NOT list_contains(f, c[1]) AS nf, NOT list_contains(m, c[1]) AS nm FROM a), e AS (SELECT *, CASE WHEN c[1] = c[2] THEN CASE WHEN nf AND nm THEN CASE WHEN c[1] = '0' THEN 8 ELSE 5 END WHEN nf THEN CASE WHEN c[1] = '0' THEN 6 ELSE 3 END WHEN nm THEN CASE WHEN c[1] = '0' THEN 7 ELSE 4 END ELSE 0 END WHEN (NOT nf AND list_contains(m, c[2])) OR (list_contains(f, c[2]) AND NOT nm) THEN 0 WHEN (c[1] <> '0' AND nf AND nm) OR (c[2] <> '0' AND NOT list_contains(f, c[2]) AND NOT list_contains(m, c[2])) THEN 2 ELSE 1 END AS code FROM l)"


@_add(lens.SQL + _TRIO + _CODES + " SELECT key, trio, code, code IN (2, 3, 4, 5) AS de_novo, code IN (2, 5) AS strict FROM e WHERE code > 0")
def j13_mendelian_errors(spark, sf_dir):
    return families.mendelian_errors(_trios(spark, sf_dir)).select("key", "trio", "code", "de_novo", "strict")


_MODES = {
    "autosomalRecessive": "child = '1/1' AND father = '0/1' AND mother = '0/1'",
    "autosomalDominant": "child IN ('0/1', '1/1') AND father = '0/0' AND mother IN ('0/1', '1/1')",
    "deNovo": "(child IN ('0/1', '1|2') AND father = '0/0' AND mother = '0/0') OR (child = '1/1' AND (father = '0/0' OR mother = '0/0'))",
}


@_add(lens.SQL + _TRIO + " UNION ALL ".join(f" SELECT key, trio, '{m}' AS mode FROM t WHERE {w}" for m, w in _MODES.items()))
def j14_modes(spark, sf_dir):
    return families.by_modes(_trios(spark, sf_dir).withColumn("chrom", F.lit("1")), tuple(_MODES)).select("key", "trio", "mode")


_ON = "CASE WHEN key % 5 = 0 THEN 'X' WHEN key % 5 = 1 THEN 'Y' WHEN key % 5 = 2 THEN 'MT' ELSE '1' END"
_LINKED = {
    "xLinkedRecessive": "c = 'X' AND child = '1/1' AND father = '0/0' AND mother = '0/1'",
    "xLinkedDominant": "c = 'X' AND ((child IN ('0/1', '1/1') AND father = '0/0' AND mother IN ('0/1', '1/1')) OR (child = '0/1' AND father = '1/1' AND mother = '0/0'))",
    "yLinked": "c = 'Y' AND child = '1/1' AND father = '1/1'",
    "mitochondrial": "c = 'MT' AND child IN ('0/1', '1/1') AND mother IN ('0/1', '1/1')",
    "deNovoStrict": "c = '1' AND child <> '0/0' AND father = '0/0' AND mother = '0/0'",
    "mendelianError": "(child IN ('0/1', '1|2') AND father = '0/0' AND mother = '0/0' AND c = '1') OR (c = '1' AND ((child = '0/1' AND father = '1/1' AND mother = '1/1') OR (child = '1/1' AND (father = '0/0' OR mother = '0/0')) OR (child = '0/0' AND (father = '1/1' OR mother = '1/1')))) OR (c IN ('X', 'MT') AND ((child = '0/0' AND mother = '1/1') OR (child = '1/1' AND mother = '0/0'))) OR (c = 'Y' AND ((child = '0/0' AND father = '1/1') OR (child = '1/1' AND father = '0/0')))",
}


@_add(lens.SQL + _TRIO + f", o AS (SELECT *, {_ON} AS c FROM t)" + " UNION ALL ".join(f" SELECT key, trio, '{m}' AS mode FROM o WHERE {w}" for m, w in _LINKED.items()))
def j14_modes_by_chromosome(spark, sf_dir):
    """Modes bound to sex chromosomes and mitochondria, strict de novo and Mendelian errors, in one pass."""
    return families.by_modes(_trios(spark, sf_dir).withColumn("chrom", F.expr(_ON)), tuple(_LINKED)).select("key", "trio", "mode")


@_add(lens.SQL + _TRIO + f", h AS (SELECT trio, key, CASE WHEN {_ALT.format('father')} THEN 'father' ELSE 'mother' END AS origin FROM t WHERE child = '0/1' AND ({_ALT.format('father')}) <> ({_ALT.format('mother')})), g AS (SELECT DISTINCT key, gene FROM cts), r2 AS (SELECT * FROM h JOIN g USING (key)) SELECT key, trio, gene, origin FROM r2 WHERE (trio, gene) IN (SELECT (trio, gene) FROM r2 GROUP BY trio, gene HAVING count(DISTINCT origin) = 2)")
def j11_compound_heterozygous_variants(spark, sf_dir):
    """The variants that pair, one row each, with the gene and the parent that they come from."""
    return families.compound_heterozygous_variants(_trios(spark, sf_dir), lens.consequences(spark, sf_dir), "gene")


@_add(lens.SQL + _TRIO + f", h AS (SELECT trio, key, CASE WHEN {_ALT.format('father')} THEN 'father' ELSE 'mother' END AS origin FROM t WHERE child = '0/1' AND ({_ALT.format('father')}) <> ({_ALT.format('mother')})), g AS (SELECT DISTINCT key, gene FROM cts) SELECT trio, gene, count(*) FILTER (WHERE origin = 'father') AS n_father, count(*) FILTER (WHERE origin = 'mother') AS n_mother, count(*) FILTER (WHERE origin = 'father') * count(*) FILTER (WHERE origin = 'mother') AS n_pairs FROM h JOIN g USING (key) GROUP BY 1, 2 HAVING n_pairs > 0")
def j11_compound_heterozygous(spark, sf_dir):
    return families.compound_heterozygotes(_trios(spark, sf_dir), lens.consequences(spark, sf_dir))


@_add(lens.SQL + f", c AS ({_CARRIED}), q AS (SELECT DISTINCT sample FROM c JOIN variants USING (key) WHERE chrom = '1' AND type = 'SNV'), r AS (SELECT DISTINCT sample FROM c WHERE key % 97 = 0) SELECT sample FROM members WHERE sample IN (SELECT * FROM q) AND sample NOT IN (SELECT * FROM r) OR sample IN (SELECT sample FROM members WHERE cohort = 'C3')")
def j16_eligibility(spark, sf_dir):
    c = _carried(spark, sf_dir)
    q = c.join(lens.variants(spark, sf_dir).filter("chrom = '1' AND type = 'SNV'"), "key", "left_semi")
    everyone = lens.members(spark)
    return samples.eligible(("or", ("and", q, ("not", c.filter("key % 97 = 0"))), ("not", ("not", everyone.filter("cohort = 'C3'")))), everyone).select("sample")


@_add(lens.SQL + f", c AS ({_CARRIED}), w AS (SELECT gene FROM cts WHERE gene IN ('G1', 'G2', 'G3', 'G4') GROUP BY 1), h AS (SELECT DISTINCT sample, gene FROM c JOIN cts USING (key) WHERE gene IN (SELECT gene FROM w)) SELECT sample FROM h GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM w)")
def j17_samples_in_all(spark, sf_dir):
    g = lens.consequences(spark, sf_dir).filter("gene IN ('G1', 'G2', 'G3', 'G4')").select("key", "gene").distinct()
    return samples.in_all(_carried(spark, sf_dir).join(g, "key").select("sample", "gene"), g, "sample", "gene")


@_add(lens.SQL + f", c AS ({_CARRIED}) SELECT DISTINCT sample FROM c WHERE key IN (SELECT key FROM variants WHERE cadd > 39)")
def j17_samples_in_any(spark, sf_dir):
    return _carried(spark, sf_dir).join(lens.variants(spark, sf_dir).filter("cadd > 39"), "key", "left_semi").select("sample").distinct()


@_add(lens.SQL + "SELECT g.gene, g.chrom, count(DISTINCT v.key) AS n FROM (SELECT gene, chrom, min(start) AS lo, max(start) AS hi FROM cts JOIN variants USING (key) WHERE gene IN ('G10', 'G11') GROUP BY 1, 2) g JOIN variants v ON v.chrom = g.chrom AND v.start <= hi AND v.\"end\" >= lo GROUP BY 1, 2")
def j15_gene_regions(spark, sf_dir):
    v = lens.variants(spark, sf_dir)
    genes = lens.consequences(spark, sf_dir).filter("gene IN ('G10', 'G11')").join(v, "key").groupBy("gene", "chrom").agg(F.min("start").alias("start"), F.max("start").alias("end"))
    return overlap.overlaps(v.select("key", "chrom", "start", "end"), genes).groupBy(F.col("r_gene").alias("gene"), "chrom").agg(F.countDistinct("key").alias("n"))


@_add(lens.SQL + ", s AS (SELECT *, max(\"end\") OVER (PARTITION BY chrom ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT chrom, start, start + key % 2000 AS \"end\" FROM variants)), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT chrom, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n FROM i GROUP BY chrom, island")
def u05_merged_regions(spark, sf_dir):
    return overlap.merged(lens.variants(spark, sf_dir).selectExpr("chrom", "start", "start + key % 2000 AS end"))


@_add(lens.SQL + "SELECT key, sample, ps, (SELECT count(*) FROM p b WHERE b.sample = a.sample AND b.chrom = a.chrom AND b.ps = a.ps AND b.start BETWEEN a.start - 5000 AND a.start + 5000) - 1 AS n_phased FROM p a".replace("SELECT key, sample, ps", ", p AS (SELECT c.key, c.sample, v.chrom, v.start, v.start // 100000 AS ps FROM calls c JOIN variants v USING (key) WHERE phased) SELECT key, sample, ps", 1))
def w01_phased(spark, sf_dir):
    rows = lens.calls(spark, sf_dir).join(lens.variants(spark, sf_dir), "key").withColumn("ps", F.when(F.col("phased"), F.expr("start div 100000")))
    return records.phased_near(rows, 5000).select("key", "sample", "ps", "n_phased")


@_add(lens.SQL + "SELECT key, chrom, start, (SELECT count(*) FROM variants b WHERE b.chrom = a.chrom AND b.start BETWEEN a.start - 20 AND a.start + 20) - 1 AS n_near FROM variants a")
def w03_clusters(spark, sf_dir):
    return overlap.nearby(lens.variants(spark, sf_dir).select("key", "chrom", "start"), 20, "chrom")
