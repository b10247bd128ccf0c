"""Duplicates, gaps, merges, versions, exports and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lens
from ..functions import variant as V
from ..operators import records
from ..sources import tabular, vcf

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


@_add("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE WHEN l_discount <= 0.05 THEN 0 ELSE 1 END, l_extendedprice DESC, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def w02_best_duplicate(spark, sf_dir):
    rows = lens.read(spark, sf_dir, "lineitem")
    order = [F.expr("l_discount <= 0.05").desc(), F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_suppkey")]
    return records.best_duplicate(rows, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@_add("SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1")
def w02_discard_duplicates(spark, sf_dir):
    return records.without_duplicates(lens.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")


@_add(lens.SQL + "SELECT key, count(DISTINCT file) AS n_files, count(*) AS n_calls, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM calls GROUP BY 1")
def j20_merge_files(spark, sf_dir):
    return records.merge_files(lens.calls(spark, sf_dir))


_ARCHIVE = "SELECT sample, chrom, start, start + CASE WHEN gt = '0/0' THEN 20000 ELSE key % 50 END AS \"end\", gt = '0/0' AS is_reference, gt FROM calls JOIN variants USING (key)"


@_add(lens.SQL + f", x AS ({_ARCHIVE}), vs AS (SELECT * FROM variants), m AS (SELECT v.key, v.chrom, v.start, v.\"end\", s.sample FROM vs v CROSS JOIN members s WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.key = v.key AND c.sample = s.sample)), f AS (SELECT m.key, m.sample, count(*) FILTER (WHERE NOT is_reference) AS o, min(gt) FILTER (WHERE NOT is_reference) AS other, min(gt) FILTER (WHERE is_reference) AS ref FROM m LEFT JOIN x ON x.sample = m.sample AND x.chrom = m.chrom AND x.start <= m.\"end\" AND x.\"end\" >= m.start GROUP BY 1, 2) SELECT key, sample, CASE WHEN o > 1 THEN 'MULTI' WHEN o = 1 THEN 'VARIANT' WHEN ref IS NOT NULL THEN 'REFERENCE' ELSE 'GAP' END AS status, CASE WHEN o > 1 THEN '2/2' WHEN o = 1 THEN CASE other WHEN '1/1' THEN '2/2' WHEN '0/1' THEN '0/2' WHEN '1|2' THEN '2|.' END WHEN ref IS NOT NULL THEN ref ELSE './.' END AS gt FROM f")
def j21_fill_gaps(spark, sf_dir):
    v, c = lens.variants(spark, sf_dir), lens.calls(spark, sf_dir)
    return records.fill_gaps(v, lens.members(spark), c, _archive(v, c))


def _archive(v, c):
    return c.join(v, "key").select("sample", "chrom", "start", (F.col("start") + F.when(F.col("gt") == "0/0", 20000).otherwise(F.col("key") % 50)).alias("end"), (F.col("gt") == "0/0").alias("is_reference"), "gt")


@_add(lens.SQL + "SELECT key FROM variants WHERE key NOT IN (SELECT key FROM calls)")
def x12_prune(spark, sf_dir):
    held = lens.calls(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n_calls"))
    return records.prunable(held, lens.variants(spark, sf_dir)).select("key")


@_add("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 10 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT o_orderkey + 1000000000, 'added' FROM orders WHERE o_orderkey % 100 = 0")
def k05_upsert(spark, sf_dir):
    o = lens.read(spark, sf_dir, "orders")
    table = o.selectExpr("o_orderkey AS key", "o_orderstatus AS status")
    changes = o.filter("o_orderkey % 10 = 0").selectExpr("o_orderkey AS key", "'new' AS status").unionByName(o.filter("o_orderkey % 100 = 0").selectExpr("o_orderkey + 1000000000 AS key", "'added' AS status"))
    return records.upsert(table, changes, ["key"])


@_add("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def c01_latest_version(spark, sf_dir):
    return records.latest(lens.read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@_add("SELECT l_orderkey AS key, 'b' AS missing_in FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey % 50 = 0 UNION ALL SELECT o_orderkey, 'a' FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def c08_sync(spark, sf_dir):
    a = lens.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS key")
    b = lens.read(spark, sf_dir, "orders").filter("o_orderkey % 50 <> 0").selectExpr("o_orderkey AS key")
    return records.out_of_sync(a, b, ["key"])


@_add(lens.SQL + "SELECT c.key, c.sample FROM calls c JOIN members m USING (sample) WHERE m.cohort IN ('C0', 'C2')")
def c03_granted(spark, sf_dir):
    grants = lens.members(spark).filter("cohort IN ('C0', 'C2')")
    return lens.calls(spark, sf_dir).join(grants, "sample", "left_semi").select("key", "sample")


@_add(lens.SQL + "SELECT key FROM variants WHERE key NOT IN (SELECT key FROM evidence)")
def x06_pending(spark, sf_dir):
    return lens.variants(spark, sf_dir).join(lens.clinical(spark, sf_dir), "key", "left_anti").select("key")


@_add(lens.SQL + "SELECT sample, start // 100000 AS batch, replace(gt, '|', '/') AS gt, count(*) AS n FROM calls JOIN variants USING (key) WHERE gt <> '0/0' GROUP BY 1, 2, 3")
def x01_sample_index(spark, sf_dir):
    rows = lens.calls(spark, sf_dir).join(lens.variants(spark, sf_dir), "key").filter(V.genotype_class(F.col("gt")) != "HOM_REF")
    return rows.groupBy("sample", F.expr("start div 100000").alias("batch"), V.unphased(F.col("gt")).alias("gt")).agg(F.count(F.lit(1)).alias("n"))


#: All members.
SAMPLES = list(range(20))
_ALL_GTS = [f"coalesce(max(CASE WHEN sample = {s} THEN gt END), './.') AS g{s}" for s in SAMPLES]


@_add(lens.SQL + f", g AS (SELECT v.key, chrom, start, rs, reference, alternate, \"end\", type, {', '.join(_ALL_GTS)} FROM variants v LEFT JOIN calls c USING (key) GROUP BY ALL) SELECT key, concat_ws(chr(9), chrom, start, coalesce(rs, '.'), reference, alternate, '.', 'PASS', 'END=' || \"end\" || ';TYPE=' || type, 'GT', {', '.join(f'g{s}' for s in SAMPLES)}) AS line FROM g")
def k02_vcf_lines(spark, sf_dir):
    return vcf.lines(lens.variants(spark, sf_dir), lens.calls(spark, sf_dir), SAMPLES)


@_add(lens.SQL + "SELECT chrom, start, reference, alternate, type FROM variants")
def s01_vcf_records(spark, sf_dir):
    """Variants written as VCF lines and read again."""
    lines = vcf.lines(lens.variants(spark, sf_dir), lens.calls(spark, sf_dir), SAMPLES)
    rows = vcf.biallelic(vcf.records(lines.select(F.col("line").alias("value"))))
    return rows.select("chrom", "start", "reference", "alternate", F.element_at("info", "TYPE").alias("type"))


_BASE = "coalesce(max(CASE WHEN sample = {0} THEN CASE string_split_regex(gt, '[/|]')[{1}] WHEN '0' THEN reference WHEN '1' THEN alternate ELSE '0' END END), '0')"


_ALL_BASES = " || ' ' || ".join(_BASE.format(s, i) for s in SAMPLES for i in (1, 2))


@_add(lens.SQL + f"SELECT key, chrom || ' ' || (chrom || ':' || start || ':' || reference || ':' || alternate) || ' 0 ' || start || ' ' || {_ALL_BASES} AS line FROM variants v LEFT JOIN calls USING (key) GROUP BY key, chrom, start, reference, alternate")
def k03_tped(spark, sf_dir):
    return vcf.tped(lens.variants(spark, sf_dir), lens.calls(spark, sf_dir), SAMPLES)


@_add(lens.SQL + ", t AS (SELECT CAST(range % 22 + 1 AS VARCHAR) AS chrom, range * 9973 % 950000 + 1 AS start, range * 9973 % 950000 + 15000 AS \"end\", 'f' || (range % 7) AS name FROM range(150)) SELECT v.key, string_agg(DISTINCT name, ',' ORDER BY name) AS features FROM variants v LEFT JOIN t ON v.chrom = t.chrom AND v.start <= t.\"end\" AND v.\"end\" >= t.start GROUP BY 1")
def s17_track(spark, sf_dir):
    track = spark.range(150).selectExpr("CAST(id % 22 + 1 AS STRING) AS chrom", "id * 9973 % 950000 + 1 AS start", "id * 9973 % 950000 + 15000 AS end", "concat('f', id % 7) AS name")
    return tabular.annotate(lens.variants(spark, sf_dir), track, "name").select("key", "features")


@_add(lens.SQL + "SELECT sample, max(key) AS last, count(*) AS n FROM calls JOIN variants USING (key) WHERE sample = 7 AND chrom = '9' GROUP BY 1")
def s11_sample_scan(spark, sf_dir):
    rows = lens.calls(spark, sf_dir).filter("sample = 7").join(lens.variants(spark, sf_dir).filter("chrom = '9'"), "key", "left_semi")
    return rows.groupBy("sample").agg(F.max("key").alias("last"), F.count(F.lit(1)).alias("n"))


@_add(lens.SQL + "SELECT gt, replace(gt, '|', '/') AS plain, CASE WHEN gt = '0/0' THEN 'HOM_REF' WHEN gt = '1/1' THEN 'HOM_ALT' WHEN gt = '0/1' THEN 'HET_REF' ELSE 'HET_ALT' END AS class, count(*) AS n FROM calls GROUP BY ALL")
def e01_genotypes(spark, sf_dir):
    gt = F.col("gt")
    return lens.calls(spark, sf_dir).groupBy("gt", V.unphased(gt).alias("plain"), V.genotype_class(gt).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@_add(lens.SQL + "SELECT key, chrom || ':' || start || ':' || reference || ':' || alternate AS id, lpad(chrom, 2, '0') AS chrom_order, reference || alternate IN ('AG', 'GA', 'CT', 'TC') AS transition FROM variants")
def e06_identity(spark, sf_dir):
    rows = lens.variants(spark, sf_dir)
    return rows.select("key", V.variant_id().alias("id"), V.chrom_order("chrom").alias("chrom_order"), V.is_transition(F.col("reference"), F.col("alternate")).alias("transition"))


@_add(lens.SQL + "SELECT key, start + 1 AS start, reference, alternate FROM variants")
def e08_trimmed(spark, sf_dir):
    """A base before and two behind both alleles are taken off again."""
    rows = lens.variants(spark, sf_dir)
    pad = lambda c: F.concat(F.lit("N"), F.col(c), F.lit("TT"))
    return rows.select("key", V.trimmed(F.col("start"), pad("reference"), pad("alternate")).alias("t")).select("key", "t.*")


@_add(lens.SQL + "SELECT CASE WHEN n < 1000 THEN '<1Kb' WHEN n < 10000 THEN '1-10Kb' WHEN n < 100000 THEN '10-100Kb' WHEN n < 1000000 THEN '100Kb-1Mb' WHEN n < 10000000 THEN '1Mb-10Mb' ELSE '>10Mb' END AS size, count(*) AS n FROM (SELECT start * (key % 30) AS n FROM variants) GROUP BY 1")
def e14_sizes(spark, sf_dir):
    return lens.variants(spark, sf_dir).groupBy(V.size_class(F.col("start") * (F.col("key") % 30)).alias("size")).agg(F.count(F.lit(1)).alias("n"))
