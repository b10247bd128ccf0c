"""Facets, histograms, ranks and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lens
from ..functions import variant as V
from ..operators import overlap, stats
from ..plans import facets
from ..plans import filters
from ..plans import language as L

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_SPLIT = "string_split_regex(gt, '[/|]')"
_ALT = f"len(list_filter({_SPLIT}, lambda a: a = '1'))"
_NONREF = f"len(list_filter({_SPLIT}, lambda a: a NOT IN ('0', '.')))"


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _facet(name: str, text: str, sql: str):
    levels = L.facets(text)[0]
    QUERIES[name] = lambda spark, sf_dir: facets.facet(lens.wide(spark, sf_dir, facets.parts(levels)), levels)
    ORACLE_SQL[name] = lens.SQL + sql


_FLAG_WHERE = "type IN ('SNV', 'INDEL', 'INSERTION', 'DELETION') AND chrom IN ('1', '2', '3') AND EXISTS (SELECT 1 FROM calls c WHERE c.key = v.key AND list_contains(filter, 'PASS')) AND EXISTS (SELECT 1 FROM calls c WHERE c.key = v.key AND sample IN (1, 2) AND list_contains(" + _SPLIT + ", '1'))"


@_add(lens.SQL + f"SELECT chrom AS level_1, type AS level_2, count(*) AS n FROM variants v WHERE {_FLAG_WHERE} GROUP BY GROUPING SETS ((1, 2), (1))")
def a02_nested_facet(spark, sf_dir):
    rows = filters.query(lens.wide(spark, sf_dir, ("calls",)), {"type": "SNV,INDEL", "region": "1,2,3", "filter": "PASS", "sample": "1,2"})
    return facets.facet(rows, L.facets("chromosome>>type")[0])


_facet("a03_categorical", "biotype", "SELECT level_1, count(*) AS n FROM (SELECT DISTINCT v.key, coalesce(biotype, 'other') AS level_1 FROM variants v LEFT JOIN cts USING (key)) GROUP BY 1")
_facet("a03_nested_values", "chromosome[1,2]>>consequenceType", "SELECT chrom AS level_1, term AS level_2, count(DISTINCT key) AS n FROM (SELECT v.key, chrom, coalesce(term, 'other') AS term FROM variants v LEFT JOIN cts USING (key) WHERE chrom IN ('1', '2')) GROUP BY GROUPING SETS ((1, 2), (1))")
_facet("a04_chromosome", "chromosome", "SELECT chrom AS level_1, count(*) AS n FROM variants GROUP BY 1")
_facet("a05_type", "type[SNV,MNV]", "SELECT type AS level_1, count(*) AS n FROM variants WHERE type IN ('SNV', 'MNV') GROUP BY 1")
_facet("a07_density", "chromDensity:200000", "SELECT chrom || ':' || (start // 200000 * 200000) AS level_1, count(*) AS n FROM variants GROUP BY 1")
_facet("a09_genotype", "genotype", "SELECT level_1, count(*) AS n FROM (SELECT DISTINCT v.key, coalesce(replace(gt, '|', '/'), 'other') AS level_1 FROM variants v LEFT JOIN calls USING (key)) GROUP BY 1")
_facet("a10_length", "length", "SELECT CASE WHEN n < 1 THEN '<1' WHEN n < 5 THEN '[1, 5)' WHEN n < 10 THEN '[5, 10)' WHEN n < 20 THEN '[10, 20)' WHEN n < 50 THEN '[20, 50)' ELSE '[50, inf)' END AS level_1, count(*) AS n FROM (SELECT \"end\" - start + 1 AS n FROM variants) GROUP BY 1")
_facet("a12_average", "type>>avg(cadd_scaled)", "SELECT type AS level_1, count(*) AS n, avg(cadd) AS value FROM variants GROUP BY 1")
QUERIES["a12_average"] = (lambda f: lambda spark, sf_dir: f(spark, sf_dir).withColumn("value", F.round("value", 6)))(QUERIES["a12_average"])
ORACLE_SQL["a12_average"] = lens.SQL + "SELECT type AS level_1, count(*) AS n, round(avg(cadd), 6) AS value FROM variants GROUP BY 1"
_facet("a12_percentile", "type>>percentile(popFreq)", "SELECT type AS level_1, count(*) AS n, quantile_cont(freq, 0.5) AS value FROM variants GROUP BY 1")
QUERIES["a12_percentile"] = (lambda f: lambda spark, sf_dir: f(spark, sf_dir).withColumn("value", F.round("value", 6)))(QUERIES["a12_percentile"])
ORACLE_SQL["a12_percentile"] = lens.SQL + "SELECT type AS level_1, count(*) AS n, round(quantile_cont(freq, 0.5), 6) AS value FROM variants GROUP BY 1"


@_add(lens.SQL + "SELECT label, count(*) AS n FROM (SELECT CASE WHEN cadd IS NULL THEN 'NA' WHEN cadd < 10 THEN '(-inf, 10)' WHEN cadd < 20 THEN '[10, 20)' WHEN cadd < 30 THEN '[20, 30)' ELSE '[30, inf)' END AS label FROM variants UNION ALL SELECT CASE WHEN cadd IS NULL THEN 'NA' WHEN cadd <= 10 THEN '(-inf, 10]' WHEN cadd <= 20 THEN '(10, 20]' ELSE '(20, inf)' END FROM variants) GROUP BY 1")
def a06_ranges(spark, sf_dir):
    rows = lens.variants(spark, sf_dir)
    both = rows.select(facets.range_label(F.col("cadd"), [10, 20, 30]).alias("label")).unionByName(rows.select(facets.range_label(F.col("cadd"), [10, 20], upper_closed=True).alias("label")))
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@_add(lens.SQL + "SELECT chrom, count(*) FILTER (WHERE reference || alternate IN ('AG', 'GA', 'CT', 'TC')) AS over, count(*) FILTER (WHERE reference || alternate NOT IN ('AG', 'GA', 'CT', 'TC')) AS under, CAST(over AS DOUBLE) / nullif(under, 0) AS ratio FROM variants GROUP BY 1".replace("AS over,", 'AS "over",').replace("CAST(over", 'CAST("over"'))
def a08_titv(spark, sf_dir):
    r, a = F.col("reference"), F.col("alternate")
    return facets.ratio(lens.variants(spark, sf_dir), V.is_transition(r, a), V.is_transversion(r, a), "chrom")


@_add(lens.SQL + "SELECT biotype AS level_1, count(DISTINCT key) AS n FROM cts WHERE term = 'missense_variant' GROUP BY 1")
def a11_filter_transcript(spark, sf_dir):
    rows = lens.wide(spark, sf_dir, ("cts",)).withColumn("cts", F.filter("cts", lambda c: c["term"] == "missense_variant")).filter(F.size("cts") > 0)
    return facets.facet(rows, L.facets("biotype")[0])


@_add(lens.SQL + "SELECT t.level_1, coalesce(n, 0) AS n FROM (SELECT unnest(['SNV', 'CNV', 'MNV']) AS level_1) t LEFT JOIN (SELECT type AS level_1, count(*) AS n FROM variants GROUP BY 1) USING (level_1)")
def a13_zeros(spark, sf_dir):
    return facets.included_zeros(facets.facet(lens.variants(spark, sf_dir), L.facets("type")[0]), ["SNV", "CNV", "MNV"])


@_add(lens.SQL + "SELECT DISTINCT gene FROM cts JOIN variants USING (key) WHERE chrom = '2'")
def a14_distinct(spark, sf_dir):
    return lens.consequences(spark, sf_dir).join(lens.variants(spark, sf_dir).filter("chrom = '2'"), "key", "left_semi").select("gene").distinct()


@_add(lens.SQL + "SELECT b.bin, count(key) AS n, CASE WHEN count(key) > 0 THEN round(ln(count(key)), 9) ELSE 0 END AS log_n FROM (SELECT 1 + range * 5000 AS bin FROM range(200)) b LEFT JOIN variants v ON v.chrom = '1' AND v.start BETWEEN 1 AND 1000000 AND 1 + (v.start - 1) // 5000 * 5000 = b.bin GROUP BY 1")
def a15_frequency(spark, sf_dir):
    return facets.density(lens.variants(spark, sf_dir), "1", 1, 1_000_000, 5000).withColumn("log_n", F.round("log_n", 9))


@_add(lens.SQL + "SELECT gene AS value, count(DISTINCT key) AS n FROM cts GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def a16_rank(spark, sf_dir):
    return facets.rank(lens.consequences(spark, sf_dir), F.col("gene"), 20)


@_add(lens.SQL + "SELECT gene, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM cts GROUP BY 1")
def a17_group(spark, sf_dir):
    return lens.consequences(spark, sf_dir).groupBy("gene").agg(F.array_join(F.sort_array(F.collect_set("term")), ",").alias("terms"))


@_add("SELECT CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3, 4")
def a18_dates(spark, sf_dir):
    rows = lens.read(spark, sf_dir, "events")
    return rows.groupBy(F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"), "event_type").agg(F.count(F.lit(1)).alias("n"))


_COHORT = f", n AS (SELECT cohort, count(*) AS n_samples FROM members GROUP BY 1), s AS (SELECT key, cohort, count(*) AS n_calls, CAST(sum({_ALT}) AS BIGINT) AS alt, CAST(sum({_NONREF}) AS BIGINT) AS non_ref, count(*) FILTER (WHERE gt = '0/1') AS het, count(*) FILTER (WHERE gt = '1/1') AS hom_alt, count(*) FILTER (WHERE gt = '0/0') AS hr, count(*) FILTER (WHERE list_contains(filter, 'PASS')) AS n_pass FROM calls JOIN members USING (sample) GROUP BY 1, 2), cs AS (SELECT s.*, n_samples, hr + n_samples - n_calls AS hom_ref, alt / (2 * n_samples) AS alt_freq, 1 - non_ref / (2 * n_samples) AS ref_freq FROM s JOIN n USING (cohort))"


@_add(lens.SQL + _COHORT + " SELECT key, cohort, n_calls, alt, hom_ref, het, hom_alt, round(alt_freq, 9) AS alt_freq, round(ref_freq, 9) AS ref_freq, round(least(alt_freq, ref_freq), 9) AS maf, round(least(hom_ref, het, hom_alt) / n_samples, 9) AS mgf, round(n_pass / n_calls, 9) AS pass_freq FROM cs")
def a19_cohort_stats(spark, sf_dir):
    rows = stats.cohort_stats(lens.calls(spark, sf_dir), lens.members(spark))
    return rows.select("key", "cohort", "n_calls", "alt", "hom_ref", "het", "hom_alt", *(F.round(c, 9).alias(c) for c in ("alt_freq", "ref_freq", "maf", "mgf", "pass_freq")))


@_add(lens.SQL + _COHORT + " SELECT DISTINCT key FROM cs WHERE cohort = 'C1' AND least(alt_freq, 1 - alt_freq) > 0.2")
def f17_cohort_maf(spark, sf_dir):
    return stats.cohort_stats(lens.calls(spark, sf_dir), lens.members(spark)).filter((F.col("cohort") == "C1") & (V.minor(F.col("alt_freq")) > 0.2)).select("key")


@_add(lens.SQL + _COHORT + " SELECT key, cohort FROM cs WHERE alt_freq >= 0.1 AND n_pass / n_calls >= 0.5 AND ref_freq < 0.95")
def f15_cohort_filters(spark, sf_dir):
    return stats.cohort_stats(lens.calls(spark, sf_dir), lens.members(spark)).filter("alt_freq >= 0.1 AND pass_freq >= 0.5 AND ref_freq < 0.95").select("key", "cohort")


@_add(lens.SQL + _COHORT + " SELECT key, string_agg(cohort || ':' || alt, ',' ORDER BY cohort) AS found FROM cs WHERE alt > 0 GROUP BY 1")
def a27_population(spark, sf_dir):
    rows = stats.population_frequencies(stats.cohort_stats(lens.calls(spark, sf_dir), lens.members(spark)))
    return rows.select("key", F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["cohort"], x["alt"].cast("string"))), ",").alias("found"))


@_add(lens.SQL + "SELECT sample, count(*) AS n, count(*) FILTER (WHERE gt IN ('0/1', '1|2')) AS het, count(*) FILTER (WHERE reference || alternate IN ('AG', 'GA', 'CT', 'TC')) AS ti, count(*) FILTER (WHERE reference || alternate NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv, CAST(sum(dp) AS BIGINT) AS depth, round(het / n, 9) AS het_rate, round(ti / nullif(tv, 0), 9) AS ti_tv FROM calls JOIN variants USING (key) WHERE gt <> '0/0' GROUP BY 1")
def a22_sample_stats(spark, sf_dir):
    return stats.sample_stats(lens.calls(spark, sf_dir), lens.variants(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("het_rate", "ti_tv")})


@_add(lens.SQL + "SELECT sample, CASE WHEN dp < 5 THEN '<5' WHEN dp < 10 THEN '5-10' WHEN dp < 15 THEN '10-15' WHEN dp < 20 THEN '15-20' ELSE '>=20' END AS value, count(*) AS n FROM calls JOIN variants USING (key) GROUP BY 1, 2 UNION ALL SELECT sample, replace(gt, '|', '/'), count(*) FROM calls JOIN variants USING (key) GROUP BY 1, 2")
def a22_sample_dimensions(spark, sf_dir):
    c, v = lens.calls(spark, sf_dir), lens.variants(spark, sf_dir)
    return stats.sample_dimension(c, v, "depth").unionByName(stats.sample_dimension(c, v, "genotype"))


@_add(lens.SQL + "SELECT type, count(*) AS n, count(*) FILTER (WHERE freq < 0.1) AS rare, min(start) AS first, max(\"end\") AS last, round(avg(\"end\" - start + 1), 6) AS mean_length FROM variants GROUP BY 1")
def a23_variant_set(spark, sf_dir):
    rows = lens.variants(spark, sf_dir)
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("freq") < 0.1, 1)).alias("rare"), F.min("start").alias("first"), F.max("end").alias("last"), F.round(F.avg(F.col("end") - F.col("start") + 1), 6).alias("mean_length"))


@_add(lens.SQL + f", c AS (SELECT DISTINCT key, sample // 5 AS batch FROM calls WHERE {_ALT} > 0), f AS (SELECT key, min(batch) AS batch FROM c GROUP BY 1), s AS (SELECT batch, count(*) AS seen FROM c GROUP BY 1), w AS (SELECT batch, count(*) AS new FROM f GROUP BY 1) SELECT batch, seen, coalesce(new, 0) AS new, CAST(sum(coalesce(new, 0)) OVER (ORDER BY batch) AS BIGINT) AS total FROM s LEFT JOIN w USING (batch)")
def a24_saturation(spark, sf_dir):
    return stats.saturation(lens.calls(spark, sf_dir), 5)


@_add(lens.SQL + "SELECT chrom, start // 100000 * 100000 AS bin, count(*) AS n FROM variants GROUP BY 1, 2")
def a25_histogram(spark, sf_dir):
    return stats.histogram(lens.variants(spark, sf_dir), 100_000)


@_add(lens.SQL + ", a AS (SELECT chrom, count(*) AS n FROM variants GROUP BY 1), b AS (SELECT chrom, count(*) AS n FROM variants WHERE key % 1000 <> 3 GROUP BY 1) SELECT a.chrom, a.n AS a_n, b.n AS b_n FROM a FULL JOIN b USING (chrom) WHERE a.n IS DISTINCT FROM b.n")
def a26_check(spark, sf_dir):
    count = lambda df: df.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
    v = lens.variants(spark, sf_dir)
    return stats.mismatches(count(v), count(v.filter("key % 1000 <> 3")), ["chrom"], ["n"]).select("chrom", "a_n", "b_n")


_REGIONS = ("chr0", 1, 1000), ("chr1", 500, 2500), ("chr2", 3000, 4999)


@_add(lens.SQL + ", r AS (SELECT * FROM (VALUES " + ", ".join(map(str, _REGIONS)) + ") t(r_chrom, r_start, r_end)) SELECT r_chrom, r.r_start::BIGINT AS r_start, r.r_end::BIGINT AS r_end, count(*) AS n_pos, min(depth) AS min_depth, max(depth) AS max_depth, CAST(sum(depth) AS BIGINT) AS total, round(100.0 * count(*) FILTER (WHERE depth >= 50) / (r.r_end - r.r_start + 1), 6) AS at_50, round(100.0 * count(*) FILTER (WHERE depth >= 200) / (r.r_end - r.r_start + 1), 6) AS at_200, round(sum(depth) / (r.r_end - r.r_start + 1), 6) AS mean_depth FROM coverage JOIN r ON chrom = r_chrom AND pos BETWEEN r.r_start AND r.r_end GROUP BY r_chrom, r.r_start, r.r_end")
def a28_coverage(spark, sf_dir):
    r = spark.createDataFrame(list(_REGIONS), "r_chrom string, r_start long, r_end long")
    return stats.coverage_levels(lens.coverage(spark, sf_dir), r, (50, 200)).withColumns({c: F.round(c, 6) for c in ("at_50", "at_200", "mean_depth")})


@_add(lens.SQL + ", i AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS run FROM coverage WHERE depth BETWEEN 20 AND 300) SELECT chrom, min(pos) AS start, max(pos) AS \"end\", CAST(sum(depth) AS BIGINT) AS total FROM i GROUP BY chrom, run")
def a29_coverage_islands(spark, sf_dir):
    return overlap.islands(lens.coverage(spark, sf_dir), 20, 300)


@_add(lens.SQL + ", a AS (SELECT pos // 500 AS win, CAST(sum(depth) AS BIGINT) AS x FROM coverage WHERE chrom = 'chr0' GROUP BY 1), b AS (SELECT pos // 500 AS win, CAST(sum(depth) AS BIGINT) AS y FROM coverage WHERE chrom = 'chr1' GROUP BY 1) SELECT win AS \"window\", x, y, round(log2((x / (SELECT sum(x) FROM a)) / (y / (SELECT sum(y) FROM b))), 6) AS log2_ratio FROM a JOIN b USING (win)")
def a30_log2_ratio(spark, sf_dir):
    c = lens.coverage(spark, sf_dir)
    one = lambda k: c.filter(F.col("chrom") == k).withColumn("chrom", F.lit("x"))
    return stats.log2_ratio(one("chr0"), one("chr1"), 500).select("window", "x", "y", F.round("log2_ratio", 6).alias("log2_ratio"))
