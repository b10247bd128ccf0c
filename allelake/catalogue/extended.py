"""Projections, codes, exports, the index's filters and further statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lens
from ..functions import inheritance as I
from ..functions import variant as V
from ..operators import families, overlap, records, stats
from ..plans import entities, filters, index, projection
from ..sources import vcf
from . import records as held

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_ALT = "len(list_filter(string_split_regex(gt, '[/|]'), lambda x: x = '1'))"
_TRIO = ", r AS (SELECT trio, unnest(['child', 'father', 'mother']) AS role, unnest([child, father, mother]) AS sample FROM trios), t AS (SELECT key, trio, coalesce(max(CASE WHEN role = 'child' THEN gt END), '0/0') AS child, coalesce(max(CASE WHEN role = 'father' THEN gt END), '0/0') AS father, coalesce(max(CASE WHEN role = 'mother' THEN gt END), '0/0') AS mother FROM calls JOIN r USING (sample) GROUP BY 1, 2)"


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = lens.SQL + sql
        return f

    return put


@_add(" SELECT v.key, n.name, coalesce(c.gt, './.') AS gt, coalesce(c.dp, -1) AS dp FROM variants v CROSS JOIN (VALUES ('NA12801'), ('NA12802'), ('NA12819')) n(name) LEFT JOIN calls c ON c.key = v.key AND c.name = n.name WHERE chrom IN ('3', '4')")
def p03_include_samples(spark, sf_dir):
    """Listed samples with two fields, those without a call as unknown."""
    rows = filters.query(lens.wide(spark, sf_dir, ("calls",)), {"region": "3,4"})
    ask = {"includeSample": "NA12801,NA12802,NA12819", "includeSampleData": "gt,dp", "unknownGenotype": "./."}
    return projection.project(rows, ask).select("key", F.inline("calls")).withColumn("dp", F.coalesce("dp", F.lit(-1)))


@_add(f" SELECT key, name, gt FROM calls c WHERE sample IN (1, 2) AND key IN (SELECT key FROM calls WHERE sample = 1 AND {_ALT} > 0) AND key IN (SELECT key FROM calls WHERE sample = 2 AND gt IN ('0/1', '1/0', '0|1', '1|0'))")
def p02_filtered_samples(spark, sf_dir):
    """Without a list, the samples that the filters name are returned."""
    params = {"sample": "1", "genotype": "2:0/1"}
    rows = filters.query(lens.wide(spark, sf_dir, ("calls",)), params)
    return projection.project(rows, params).select("key", F.inline("calls"))


@_add(" SELECT key, name, gt FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sample) AS rn FROM calls WHERE file IN ('file1', 'file3')) WHERE rn = 2")
def p03_include_files(spark, sf_dir):
    """The second of each variant's samples from two files."""
    return projection.project(lens.wide(spark, sf_dir, ("calls",)), {"includeSample": "all", "includeFile": "file1,file3", "sampleLimit": 1, "sampleSkip": 1}).select("key", F.inline("calls"))


_CLASSES = {"HOM_REF": "gt = '0/0'", "HOM_ALT": "gt = '1/1'", "HET": "gt IN ('0/1', '1|2')", "HET_REF": "gt = '0/1'", "HET_ALT": "gt = '1|2'", "HET_MISS": "FALSE", "MISS": "FALSE", "SEC": "FALSE", "SEC_ALT": "FALSE", "MAIN_ALT": "gt <> '0/0'", "NA": "FALSE"}


@_add(" UNION ALL ".join(f" SELECT '{c}' AS class, count(*) FILTER (WHERE {w}) AS n FROM calls" for c, w in _CLASSES.items()))
def e01_all_classes(spark, sf_dir):
    """How many calls each of the eleven classes takes in; classes overlap."""
    sums = lens.calls(spark, sf_dir).agg(*(F.count(F.when(V.is_class(F.col("gt"), c), 1)).alias(c) for c in V.CLASSES))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("class"), F.col(c).alias("n")) for c in V.CLASSES))))


_CODE = "CASE WHEN {0} IS NULL THEN 13 WHEN {0} = '0/0' THEN 0 WHEN {0} = '0/1' THEN 1 WHEN {0} = '1/1' THEN 2 ELSE 10 END"


@_add(f", p AS (SELECT key, trio, max(CASE WHEN role = 'father' THEN gt END) AS f, max(CASE WHEN role = 'mother' THEN gt END) AS m FROM calls JOIN (SELECT trio, unnest(['father', 'mother']) AS role, unnest([father, mother]) AS sample FROM trios) USING (sample) GROUP BY 1, 2) SELECT key, trio, {_CODE.format('f')} * 16 + {_CODE.format('m')} AS code, {_CODE.format('f')} >= 9 OR {_CODE.format('m')} >= 9 AS ambiguous FROM p")
def e04_genotype_codes(spark, sf_dir):
    """Parents' genotypes by the published sixteen codes, joined to one byte."""
    t = lens.trios(spark)
    roles = t.select("trio", F.col("father").alias("sample"), F.lit("f").alias("role")).unionByName(t.select("trio", F.col("mother").alias("sample"), F.lit("m").alias("role")))
    rows = lens.calls(spark, sf_dir).join(F.broadcast(roles), "sample").groupBy("key", "trio").agg(*(F.max(F.when(F.col("role") == r, F.col("gt"))).alias(r) for r in "fm"))
    f, m = V.genotype_code(F.col("f")), V.genotype_code(F.col("m"))
    return rows.select("key", "trio", V.parents_code(f, m).alias("code"), ((f >= V.MULTI_HOM) | (m >= V.MULTI_HOM)).alias("ambiguous"))


@_add(" SELECT key, start - 1 - CASE WHEN key % 3 = 0 THEN 4 WHEN key % 3 = 1 THEN 2 ELSE 0 END AS start, CASE WHEN key % 3 = 0 THEN 'CA' WHEN key % 3 = 1 THEN 'A' ELSE 'T' END AS sequence FROM variants")
def e08_left_aligned(spark, sf_dir):
    """Insertions behind repeats of their bases, moved to the front of the repeat."""
    rows = lens.variants(spark, sf_dir).withColumn("k", F.col("key") % 3)
    context = F.when(F.col("k") == 0, "GGTCACA").when(F.col("k") == 1, "GGTCAA").otherwise("GGTCACA")
    bases = F.when(F.col("k") == 0, "CA").when(F.col("k") == 1, "A").otherwise("T")
    return rows.select("key", V.left_aligned(F.col("start") - 1, context, bases).alias("t")).select("key", "t.*")


@_add(" SELECT key, string_agg(DISTINCT token, ',' ORDER BY token) AS tokens FROM (SELECT key, unnest([source, significance, source || '_' || significance, CASE WHEN status = 'confirmed' THEN source || '_' || significance || '_confirmed' END, CASE WHEN status = 'confirmed' THEN significance || '_confirmed' END, CASE WHEN status = 'confirmed' THEN source || '_confirmed' END]) AS token FROM evidence) WHERE token IS NOT NULL GROUP BY 1")
def e11_clinical_tokens(spark, sf_dir):
    rows = lens.wide(spark, sf_dir, ("evidence",)).filter(F.size("evidence") > 0)
    return rows.select("key", F.array_join(V.clinical_tokens(F.col("evidence")), ",").alias("tokens"))


_STATS = f", s AS (SELECT key, cohort, count(*) AS n_calls, CAST(sum({_ALT}) AS BIGINT) AS alt, CAST(sum(len(list_filter(string_split_regex(gt, '[/|]'), lambda x: x NOT IN ('0', '.')))) AS BIGINT) AS non_ref FROM calls JOIN members USING (sample) GROUP BY 1, 2)"


@_add(_STATS + " SELECT key, md5(string_agg(cohort || ':' || n_calls || ':' || alt, '|' ORDER BY cohort)) AS hash FROM s GROUP BY 1")
def e21_stats_hash(spark, sf_dir):
    """One hash of a variant's statistics, by which a search index tells what to load again."""
    s = stats.cohort_stats(lens.calls(spark, sf_dir), lens.members(spark))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "cohort", F.col("n_calls").cast("string"), F.col("alt").cast("string")))), "|")
    return s.groupBy("key").agg(F.md5(text.cast("binary")).alias("hash"))


_CODES = ", a AS (SELECT *, string_split_regex(child, '[/|]') AS c, string_split_regex(father, '[/|]') AS f, string_split_regex(mother, '[/|]') AS m FROM t), l AS (SELECT *, NOT list_contains(f, c[1]) AS nf, NOT list_contains(m, c[1]) AS nm FROM a), e AS (SELECT *, CASE WHEN c[1] = c[2] THEN CASE WHEN nf AND nm THEN CASE WHEN c[1] = '0' THEN 8 ELSE 5 END WHEN nf THEN CASE WHEN c[1] = '0' THEN 6 ELSE 3 END WHEN nm THEN CASE WHEN c[1] = '0' THEN 7 ELSE 4 END ELSE 0 END WHEN (NOT nf AND list_contains(m, c[2])) OR (list_contains(f, c[2]) AND NOT nm) THEN 0 WHEN (c[1] <> '0' AND nf AND nm) OR (c[2] <> '0' AND NOT list_contains(f, c[2]) AND NOT list_contains(m, c[2])) THEN 2 ELSE 1 END AS code FROM l)"


@_add(_TRIO + _CODES + " SELECT trio, chrom, code, count(*) AS n FROM e JOIN variants USING (key) WHERE code > 0 GROUP BY 1, 2, 3")
def a22_mendelian_by_chromosome(spark, sf_dir):
    """Mendelian errors of each child by chromosome and code."""
    t = families.trio_genotypes(lens.calls(spark, sf_dir), lens.trios(spark)).join(lens.variants(spark, sf_dir).select("key", "chrom"), "key")
    code = I.mendelian_error(F.col("child"), F.col("father"), F.col("mother"), F.col("chrom"))
    return t.select("trio", "chrom", code.alias("code")).filter("code > 0").groupBy("trio", "chrom", "code").agg(F.count(F.lit(1)).alias("n"))


@_add(" SELECT sample, count(*) FILTER (WHERE reference || alternate IN ('AG', 'GA', 'CT', 'TC')) AS ti, count(*) FILTER (WHERE reference || alternate NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv, CASE WHEN dp < 5 THEN '<5' WHEN dp < 10 THEN '5-10' WHEN dp < 15 THEN '10-15' WHEN dp < 20 THEN '15-20' ELSE '>=20' END AS depth, count(*) FILTER (WHERE list_contains(filter, 'PASS')) AS pass FROM calls JOIN variants USING (key) WHERE gt <> '0/0' GROUP BY sample, depth")
def a09_sample_facets(spark, sf_dir):
    """By sample and depth class: transitions, transversions and calls that pass."""
    rows = lens.calls(spark, sf_dir).filter(V.genotype_class(F.col("gt")) != "HOM_REF").join(lens.variants(spark, sf_dir), "key")
    depth = F.when(F.col("dp") < 5, "<5").when(F.col("dp") < 10, "5-10").when(F.col("dp") < 15, "10-15").when(F.col("dp") < 20, "15-20").otherwise(">=20")
    n = lambda c: F.count(F.when(c, 1))
    r, a = F.col("reference"), F.col("alternate")
    return rows.groupBy("sample", depth.alias("depth")).agg(n(V.is_transition(r, a)).alias("ti"), n(V.is_transversion(r, a)).alias("tv"), n(F.array_contains("filter", "PASS")).alias("pass"))


_SHARES = (0.1, 0.25, 0.5, 0.75, 0.9)


@_add(" SELECT chrom, count(cadd) AS n, round(avg(cadd), 6) AS avg, min(cadd) AS min, max(cadd) AS max, round(sum(cadd), 3) AS sum, round(stddev_samp(cadd), 6) AS stddev, count(DISTINCT cadd) AS distinct_values, " + ", ".join(f"round(quantile_cont(cadd, {q}), 6) AS p{int(100 * q)}" for q in _SHARES) + " FROM variants GROUP BY 1")
def a12_score_statistics(spark, sf_dir):
    """Statistics and exact percentiles of a score by chromosome."""
    c = F.col("cadd")
    every = [F.count(c).alias("n"), F.round(F.avg(c), 6).alias("avg"), F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.sum(c), 3).alias("sum"), F.round(F.stddev_samp(c), 6).alias("stddev"), F.countDistinct(c).alias("distinct_values")]
    return lens.variants(spark, sf_dir).groupBy("chrom").agg(*every, *(F.round(F.percentile(c, F.lit(q)), 6).alias(f"p{int(100 * q)}") for q in _SHARES))


@_add(", c AS (SELECT key, cohort, filter, qual FROM calls JOIN members USING (sample)), q AS (SELECT key, cohort, avg(qual) AS mean_qual FROM c GROUP BY 1, 2) SELECT key, cohort, value, count(*) AS n, round(any_value(mean_qual), 6) AS mean_qual FROM (SELECT key, cohort, unnest(filter) AS value FROM c) JOIN q USING (key, cohort) GROUP BY 1, 2, 3")
def a19_filter_counts(spark, sf_dir):
    """FILTER values by variant and cohort, and the mean quality."""
    return stats.filter_counts(lens.calls(spark, sf_dir), lens.members(spark)).withColumn("mean_qual", F.round("mean_qual", 6))


@_add(_STATS + ", f AS (SELECT *, 10 - 2 * (5 - n_calls) AS total FROM s) SELECT key, cohort, round(alt / total, 9) AS alt_freq, round(1 - non_ref / total, 9) AS ref_freq, round(least(alt / total, 1 - non_ref / total), 9) AS maf FROM f")
def a19b_frequencies(spark, sf_dir):
    """Frequencies from counts; members without a call are missing alleles."""
    s = stats.cohort_stats(lens.calls(spark, sf_dir), lens.members(spark))
    found = stats.frequencies_from_counts(F.col("n_samples"), F.col("alt"), F.col("non_ref"), 2 * (F.col("n_samples") - F.col("n_calls")))
    return s.select("key", "cohort", *(F.round(c, 9).alias(n) for c, n in zip(found, ("alt_freq", "ref_freq", "maf"))))


#: Depths that coverage is reported at.
DEPTHS = (1, 5, 10, 15, 20, 25, 30, 40, 50, 60, 75, 100)
_EXONS = "SELECT CAST(range // 4 AS BIGINT) AS transcript, range % 4 AS exon, 'chr' || (range % 3) AS chrom, CAST(range * 61 % 4800 + 1 AS BIGINT) AS start, CAST(range * 61 % 4800 + 150 AS BIGINT) AS \"end\" FROM range(48)"


@_add(f", x AS ({_EXONS}), d AS (SELECT transcript, exon, depth FROM x JOIN coverage c ON c.chrom = x.chrom AND c.pos BETWEEN x.start AND x.\"end\") SELECT transcript, exon, min(depth) AS min_depth, max(depth) AS max_depth, round(sum(depth) / 150.0, 6) AS mean_depth, " + ", ".join(f"round(100.0 * count(*) FILTER (WHERE depth >= {k}) / 150, 6) AS at_{k}" for k in DEPTHS) + " FROM d GROUP BY 1, 2")
def a28_exons(spark, sf_dir):
    """By transcript and exon: depths, and the share of bases at each reported level."""
    exons = spark.range(48).selectExpr("id div 4 AS transcript", "id % 4 AS exon", "concat('chr', id % 3) AS r_chrom", "id * 61 % 4800 + 1 AS r_start", "id * 61 % 4800 + 150 AS r_end")
    levels = stats.coverage_levels(lens.coverage(spark, sf_dir), exons, DEPTHS)
    rows = exons.join(levels, ["r_chrom", "r_start", "r_end"])
    return rows.select("transcript", "exon", "min_depth", "max_depth", *(F.round(c, 6).alias(c) for c in ("mean_depth", *(f"at_{k}" for k in DEPTHS))))


@_add(f", x AS ({_EXONS}), i AS (SELECT *, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS run FROM coverage WHERE depth BETWEEN 0 AND 60), l AS (SELECT chrom, min(pos) AS start, max(pos) AS \"end\" FROM i GROUP BY chrom, run) SELECT transcript, exon, greatest(l.start, x.start) AS start, least(l.\"end\", x.\"end\") AS \"end\" FROM x JOIN l ON l.chrom = x.chrom AND l.start <= x.\"end\" AND l.\"end\" >= x.start")
def a28_low_regions(spark, sf_dir):
    """Runs of low depth within exons."""
    exons = spark.range(48).selectExpr("concat('chr', id % 3) AS chrom", "id * 61 % 4800 + 1 AS start", "id * 61 % 4800 + 150 AS end", "id div 4 AS transcript", "id % 4 AS exon")
    low = overlap.islands(lens.coverage(spark, sf_dir), 0, 60).select("chrom", "start", "end")
    return overlap.overlaps(low, exons).select(F.col("r_transcript").alias("transcript"), F.col("r_exon").alias("exon"), F.greatest("start", "r_start").alias("start"), F.least("end", "r_end").alias("end"))


@_add(" SELECT key, sample FROM calls WHERE dp >= 15 AND dp < 33 AND qual > 30 AND list_contains(filter, 'PASS')")
def x04_index_filter(spark, sf_dir):
    """Comparisons that codes of the index decide, and looked up where they do not."""
    c = lens.calls(spark, sf_dir)
    return index.select(index.build(c), c, "dp>=15;dp<33;qual>30;filter=PASS")


@_add(" SELECT key, sample FROM calls WHERE dp < 5 OR qual <= 12.5 OR list_contains(filter, 'LowQ')")
def x04_index_filter_any(spark, sf_dir):
    c = lens.calls(spark, sf_dir)
    return index.select(index.build(c), c, "dp<5,qual<=12.5,filter=LowQ")


@_add(" SELECT code_dp, code_qual, code_filter, count(*) AS n FROM (SELECT 1 + (dp >= 5)::INT + (dp >= 10)::INT + (dp >= 15)::INT + (dp >= 20)::INT + (dp >= 30)::INT + (dp >= 50)::INT AS code_dp, 1 + (qual >= 10)::INT + (qual >= 20)::INT + (qual >= 30)::INT AS code_qual, CASE WHEN list_contains(filter, 'PASS') THEN 1 ELSE 2 END AS code_filter FROM calls) GROUP BY 1, 2, 3")
def x03_index_codes(spark, sf_dir):
    """The index by its configuration: how many calls each combination of codes holds."""
    return index.build(lens.calls(spark, sf_dir)).groupBy("code_dp", "code_qual", "code_filter").agg(F.count(F.lit(1)).alias("n"))


@_add(" SELECT sample, count(*) AS n FROM calls WHERE gt IN ('0/1', '1/1') GROUP BY 1")
def p09_index_count(spark, sf_dir):
    """Counts from the counters of the sample index, not from calls."""
    counters = held.x01_sample_index(spark, sf_dir)
    return counters.filter(F.col("gt").isin("0/1", "1/1")).groupBy("sample").agg(F.sum("n").alias("n"))


@_add(" SELECT key, concat_ws(' ', chrom, start, start, reference || '/' || alternate, '+') AS line FROM variants")
def k01_effect_lines(spark, sf_dir):
    return vcf.effect_input(lens.variants(spark, sf_dir))


@_add(_STATS + " SELECT key, concat_ws(chr(9), chrom, start, reference, alternate, cohort, n_calls, alt, non_ref) AS line FROM s JOIN variants USING (key)")
def k01_stats_lines(spark, sf_dir):
    """Statistics as tab-separated lines."""
    s = stats.cohort_stats(lens.calls(spark, sf_dir), lens.members(spark)).join(lens.variants(spark, sf_dir), "key")
    return s.select("key", F.concat_ws("\t", *(F.col(c).cast("string") for c in ("chrom", "start", "reference", "alternate", "cohort", "n_calls", "alt", "non_ref"))).alias("line"))


@_add(_STATS + " SELECT key, '{\"chromosome\":\"' || chrom || '\",\"start\":' || start || ',\"reference\":\"' || reference || '\",\"alternate\":\"' || alternate || '\",\"populationFrequencies\":[' || string_agg('{\"population\":\"' || cohort || '\",\"altAlleleCount\":' || alt || '}', ',' ORDER BY cohort) || ']}' AS line FROM s JOIN variants USING (key) WHERE alt > 0 GROUP BY key, chrom, start, reference, alternate")
def k01_frequency_json(spark, sf_dir):
    """Frequencies as one JSON document a variant."""
    s = stats.population_frequencies(stats.cohort_stats(lens.calls(spark, sf_dir), lens.members(spark))).join(lens.variants(spark, sf_dir), "key")
    found = F.transform("found", lambda x: F.struct(x["cohort"].alias("population"), x["alt"].alias("altAlleleCount")))
    return s.select("key", F.to_json(F.struct(F.col("chrom").alias("chromosome"), "start", "reference", "alternate", found.alias("populationFrequencies"))).alias("line"))


@_add(" SELECT concat_ws(' ', trio, child, father, mother, '0', '-9') AS line FROM trios UNION ALL SELECT concat_ws(' ', trio, father, '0', '0', '1', '-9') FROM trios UNION ALL SELECT concat_ws(' ', trio, mother, '0', '0', '2', '-9') FROM trios")
def k03_tfam(spark, sf_dir):
    return vcf.tfam(lens.trios(spark))


@_add(" SELECT '{\"cohort\":\"' || cohort || '\",\"samples\":[' || string_agg(sample, ',' ORDER BY sample) || ']}' AS line FROM members GROUP BY cohort")
def k06_metadata(spark, sf_dir):
    """Cohorts and their samples as JSON lines."""
    rows = lens.members(spark).groupBy("cohort").agg(F.array_sort(F.collect_list("sample")).alias("samples"))
    return rows.select(F.to_json(F.struct("cohort", "samples")).alias("line"))


_AT = "SELECT chrom, start // 3000 AS start, reference, alternate, sample, gt FROM variants JOIN calls USING (key) WHERE type = 'SNV'"


@_add(f", m AS ({_AT}), l AS (SELECT chrom, start, reference, list_sort(list(DISTINCT alternate)) AS alternates FROM m GROUP BY 1, 2, 3) SELECT m.chrom, m.start, m.reference, array_to_string(alternates, ',') AS alternates, sample, CASE gt WHEN '0/0' THEN '0/0' WHEN '0/1' THEN '0/' || list_position(alternates, alternate) WHEN '1/1' THEN list_position(alternates, alternate) || '/' || list_position(alternates, alternate) ELSE list_position(alternates, alternate) || '|' || (len(alternates) + 1) END AS gt FROM m JOIN l ON l.chrom = m.chrom AND l.start = m.start AND l.reference = m.reference")
def j20_merge_alleles(spark, sf_dir):
    """Calls of several alternates at one locus, on one list of alternates."""
    v = lens.variants(spark, sf_dir).filter("type = 'SNV'").selectExpr("key", "chrom", "start div 3000 AS start", "reference", "alternate")
    rows = v.join(lens.calls(spark, sf_dir).select("key", "sample", "gt"), "key").drop("key")
    return records.merge_alleles(rows).withColumn("alternates", F.array_join("alternates", ","))


_HET = "({0} = '0/1')::INT"


@_add(_TRIO + f", g AS (SELECT key, {_HET.format('father')} + {_HET.format('mother')} AS parents, {_ALT.replace('gt', 'child')} - CASE WHEN father = '1/1' THEN 1 ELSE 0 END - CASE WHEN mother = '1/1' THEN 1 ELSE 0 END AS d FROM t), h AS (SELECT key, parents, greatest(least(d, parents), 0) AS given FROM g WHERE parents > 0) SELECT key, CAST(sum(given) AS BIGINT) AS given, CAST(sum(parents - given) AS BIGINT) AS kept, round((sum(given) - sum(parents - given)) * (sum(given) - sum(parents - given)) / sum(parents), 6) AS chi_square FROM h GROUP BY 1")
def transmission_test(spark, sf_dir):
    t = families.trio_genotypes(lens.calls(spark, sf_dir), lens.trios(spark))
    return stats.transmission(t).withColumn("chi_square", F.round("chi_square", 6))


@_add(" SELECT 'part' AS entity, CAST(p_partkey AS BIGINT) AS id FROM part WHERE p_size > 40 AND regexp_matches(p_name, '^[a-m]') UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_acctbal < 0 OR s_nationkey = 3 UNION ALL SELECT 'nation', n_nationkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) = 3 AND o_orderstatus <> 'F' UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0")
def f47_entities(spark, sf_dir):
    """Five kinds of entities by numbers, texts, patterns, dates and negated values."""
    asked = {
        "part": ("p_partkey", [{"p_size": ">40", "p_name": "~^[a-m]"}]),
        "supplier": ("s_suppkey", [{"s_acctbal": "<0"}, {"s_acctbal": ">=0", "s_nationkey": "3"}]),
        "nation": ("n_nationkey", [{"n_regionkey": "!2"}]),
        "orders": ("o_orderkey", [{"o_orderdate": "199503", "o_orderstatus": "!=F"}]),
        "customer": ("c_custkey", [{"c_mktsegment": "BUILDING,MACHINERY", "c_acctbal": ">0"}]),
    }
    out = [entities.select(lens.read(spark, sf_dir, table), p).select(F.lit(table).alias("entity"), F.col(key).cast("long").alias("id")) for table, (key, every) in asked.items() for p in every]
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


@_add(" SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'case' ELSE c_mktsegment END AS phenotype FROM customer UNION ALL SELECT c_custkey + 1000000, 'control' FROM customer WHERE c_custkey % 20 = 0")
def c06_annotation_lines(spark, sf_dir):
    """Annotations in tab-separated lines, loaded over what is there; a line that is no pair is left out."""
    c = lens.read(spark, sf_dir, "customer")
    table = c.selectExpr("CAST(c_custkey AS BIGINT) AS id", "c_mktsegment AS phenotype")
    lines = c.filter("c_custkey % 10 = 0").selectExpr("concat(c_custkey, '\\t', 'case') AS line").unionByName(c.filter("c_custkey % 20 = 0").selectExpr("concat(c_custkey + 1000000, '\\t', 'control') AS line")).unionByName(c.filter("c_custkey % 30 = 0").selectExpr("'#' || c_name AS line"))
    return records.upsert(table, records.annotation_lines(lines, "line"), ["id"])


@_add(_TRIO + " SELECT t.trio, count(*) FILTER (WHERE child = father) AS same_father, count(*) FILTER (WHERE child = mother) AS same_mother, count(*) AS n FROM t GROUP BY 1")
def x05_parents_agreement(spark, sf_dir):
    """By family: variants at which the child has a parent's genotype."""
    t = families.trio_genotypes(lens.calls(spark, sf_dir), lens.trios(spark))
    n = lambda c: F.count(F.when(c, 1))
    return t.groupBy("trio").agg(n(F.col("child") == F.col("father")).alias("same_father"), n(F.col("child") == F.col("mother")).alias("same_mother"), F.count(F.lit(1)).alias("n"))
