"""Gene sets, panels, indexes, encodings, knockout queries, and the façade."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lens
from ..engine import Engine, project
from ..functions import variant as V
from ..operators import families, overlap, records, samples, stats
from ..plans import filters

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_SPLIT = "string_split_regex(gt, '[/|]')"
_CARRIED = f"list_contains({_SPLIT}, '1')"
_LOF = "term IN ('stop_gained', 'frameshift_variant', 'splice_donor_variant')"


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = lens.SQL + sql
        return f

    return put


def _engine(spark, sf_dir) -> Engine:
    return Engine(lambda parts: lens.wide(spark, sf_dir, parts), lens.calls(spark, sf_dir), lens.members(spark))


_SETS = "sets AS (SELECT 'G' || (range * 7 % 300) AS gene, 'GO:' || (range % 5) AS term FROM range(60))"


def _sets(spark):
    return spark.range(60).selectExpr("concat('G', id * 7 % 300) AS gene", "concat('GO:', id % 5) AS set_term")


@_add(f", {_SETS} SELECT DISTINCT key FROM cts WHERE gene IN (SELECT gene FROM sets WHERE term = 'GO:2')")
def f37_gene_set(spark, sf_dir):
    """Variants of the genes of a term; a term without genes gives none."""
    genes = _sets(spark).filter("set_term = 'GO:2'").select("gene").distinct()
    return lens.consequences(spark, sf_dir).join(genes, "gene", "left_semi").select("key").distinct()


@_add(" SELECT v.key, 'GO:2' AS term FROM variants v WHERE EXISTS (SELECT 1 FROM cts c WHERE c.key = v.key AND CAST(substr(gene, 2) AS INT) IN (SELECT p_partkey % 300 FROM part) AND CAST(substr(gene, 2) AS INT) % 7 = 2)")
def f37_gene_set_empty(spark, sf_dir):
    """Of two terms, one without genes: it adds no variant."""
    ask = lambda term: filters.select(lens.variants(spark, sf_dir), lens.tables(spark, sf_dir), {"go": term}, knowledge=lens.knowledge(spark, sf_dir)).select("key", F.lit(term).alias("term"))
    return ask("GO:2").unionByName(ask("GO:none"))


@_add(" SELECT key, cohort FROM (SELECT key, cohort, 2 * 5 - 2 * count(*) AS missing_alleles, 5 - count(*) AS missing_genotypes FROM calls JOIN members USING (sample) GROUP BY 1, 2) WHERE missing_alleles >= 8 AND missing_genotypes < 5")
def f20_missing(spark, sf_dir):
    s = stats.cohort_stats(lens.calls(spark, sf_dir), lens.members(spark))
    return s.withColumns({"mg": F.col("n_samples") - F.col("n_calls"), "ma": 2 * (F.col("n_samples") - F.col("n_calls"))}).filter("ma >= 8 AND mg < 5").select("key", "cohort")


@_add(f" SELECT key FROM variants v WHERE EXISTS (SELECT 1 FROM cts c WHERE c.key = v.key AND gene IN ('G1', 'G2', 'G3')) AND EXISTS (SELECT 1 FROM calls c WHERE c.key = v.key AND sample = 0 AND gt = '1/1') AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.key = v.key AND sample IN (1, 2) AND gt IN ('1/1', '1|1'))")
def f44_panel_recessive(spark, sf_dir):
    """A panel's genes and a recessive mode for one family: the child homozygous, the parents not."""
    params = {"gene": "G1,G2,G3", "genotype": "0:1/1;1:!1/1;2:!1/1"}
    return filters.select(lens.variants(spark, sf_dir), lens.tables(spark, sf_dir), params).select("key")


@_add(" SELECT key, chrom, start, string_agg(gene, ',' ORDER BY gene) AS genes FROM variants JOIN (SELECT DISTINCT key, gene FROM cts) USING (key) WHERE type = 'SNV' AND chrom = '6' GROUP BY 1, 2, 3")
def p01_projection(spark, sf_dir):
    rows = _engine(spark, sf_dir).query({"type": "SNV", "region": "6", "annotationExists": "true"}, include=("key", "chrom", "start", "cts.gene"), limit=None)
    return rows.select("key", "chrom", "start", F.array_join(F.sort_array(F.array_distinct("cts.gene")), ",").alias("genes"))


@_add(" SELECT key, chrom, start, \"end\", reference, alternate, type FROM variants WHERE chrom = '8'")
def p01_exclude(spark, sf_dir):
    rows = filters.query(lens.variants(spark, sf_dir), {"region": "8"})
    return project(rows, exclude=("release", "study", "cadd", "freq", "phastcons", "trait", "rs", "pops", "functional", "conserved", "scores", "custom", "gene_traits", "drugs", "keywords"))


@_add(f" SELECT DISTINCT sample FROM calls WHERE {_CARRIED} AND key IN (SELECT key FROM variants WHERE chrom = '1' AND start <= 20000)")
def j06_samples_of_variants(spark, sf_dir):
    return _engine(spark, sf_dir).samples({"region": "1:1-20000"})


@_add(" SELECT c.key, c.sample, c.gt, v.type, v.cadd FROM calls c LEFT JOIN variants v USING (key) WHERE c.sample = 11 AND c.gt = '1/1'")
def s12_index_backfill(spark, sf_dir):
    """One sample's calls from the index alone; what it lacks is filled in from the variants."""
    c = lens.calls(spark, sf_dir).filter("sample = 11 AND gt = '1/1'")
    return c.join(lens.variants(spark, sf_dir), "key", "left").select("key", "sample", "gt", "type", "cadd")


@_add(f", c AS (SELECT key, sample FROM calls WHERE {_CARRIED}), r AS (SELECT trio, unnest(['child', 'father', 'mother']) AS role, unnest([child, father, mother]) AS sample FROM trios) SELECT trio, carriers, count(*) AS n FROM (SELECT trio, key, string_agg(role, '+' ORDER BY role) AS carriers FROM c JOIN r USING (sample) GROUP BY 1, 2) GROUP BY 1, 2")
def x05_family_index(spark, sf_dir):
    """By family: how many variants each combination of members carries."""
    t = families.trio_genotypes(lens.calls(spark, sf_dir), lens.trios(spark))
    who = F.concat_ws("+", *(F.when(V.carries(F.col(r)), F.lit(r)) for r in ("child", "father", "mother")))
    return t.select("trio", who.alias("carriers")).filter("carriers <> ''").groupBy("trio", "carriers").agg(F.count(F.lit(1)).alias("n"))


@_add(" SELECT sample, CASE WHEN term = 'missense_variant' THEN 1 WHEN term = 'stop_gained' THEN 2 WHEN term = 'frameshift_variant' THEN 4 ELSE 8 END AS mask, count(*) AS n FROM calls JOIN cts USING (key) GROUP BY 1, 2")
def x02_index_annotation(spark, sf_dir):
    bit = F.when(F.col("term") == "missense_variant", 1).when(F.col("term") == "stop_gained", 2).when(F.col("term") == "frameshift_variant", 4).otherwise(8)
    return lens.calls(spark, sf_dir).join(lens.consequences(spark, sf_dir), "key").groupBy("sample", bit.alias("mask")).agg(F.count(F.lit(1)).alias("n"))


@_add(" SELECT key, bit_or(CASE biotype WHEN 'protein_coding' THEN 1 WHEN 'lincRNA' THEN 2 ELSE 4 END) AS biotypes, bit_or(CASE flag WHEN 'canonical' THEN 1 ELSE 2 END) AS flags FROM cts GROUP BY 1 HAVING (bit_or(CASE biotype WHEN 'protein_coding' THEN 1 WHEN 'lincRNA' THEN 2 ELSE 4 END) & 3) = 3")
def e17_masks(spark, sf_dir):
    """Values as bits, folded by variant; a mask filters them."""
    b = F.when(F.col("biotype") == "protein_coding", 1).when(F.col("biotype") == "lincRNA", 2).otherwise(4)
    f = F.when(F.col("flag") == "canonical", 1).otherwise(2)
    rows = lens.consequences(spark, sf_dir).groupBy("key").agg(F.bit_or(b).alias("biotypes"), F.bit_or(f).alias("flags"))
    return rows.filter(F.col("biotypes").bitwiseAND(3) == 3)


@_add(" SELECT CASE WHEN dp < 5 THEN 0 WHEN dp < 10 THEN 1 WHEN dp < 15 THEN 2 WHEN dp < 20 THEN 3 WHEN dp < 30 THEN 4 WHEN dp < 50 THEN 5 ELSE 6 END AS code, count(*) AS n FROM calls GROUP BY 1")
def e17_depth_codes(spark, sf_dir):
    """Depths as codes of the index's thresholds."""
    code = F.lit(0)
    for t in (5, 10, 15, 20, 30, 50):
        code = code + (F.col("dp") >= t).cast("int")
    return lens.calls(spark, sf_dir).groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


@_add(", g AS (SELECT trio, key, CASE gt WHEN '0/0' THEN 0 WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE 3 END AS c, role FROM calls JOIN (SELECT trio, unnest(['father', 'mother']) AS role, unnest([father, mother]) AS sample FROM trios) USING (sample)) SELECT trio, key, CAST(sum(CASE WHEN role = 'father' THEN c * 4 ELSE c END) AS BIGINT) AS parents FROM g GROUP BY 1, 2 HAVING count(*) = 2")
def e04_parents_code(spark, sf_dir):
    """Both parents' genotypes as one code, where both are called."""
    code = F.when(F.col("gt") == "0/0", 0).when(F.col("gt") == "0/1", 1).when(F.col("gt") == "1/1", 2).otherwise(3)
    t = lens.trios(spark)
    roles = t.select("trio", F.col("father").alias("sample"), F.lit(4).alias("w")).unionByName(t.select("trio", F.col("mother").alias("sample"), F.lit(1).alias("w")))
    rows = lens.calls(spark, sf_dir).join(F.broadcast(roles), "sample").groupBy("trio", "key").agg(F.sum(code * F.col("w")).cast("long").alias("parents"), F.count(F.lit(1)).alias("n"))
    return rows.filter("n = 2").drop("n")


@_add(", s AS (SELECT a.sample AS a, b.sample AS b, count(*) FILTER (WHERE replace(a.gt, '|', '/') = replace(b.gt, '|', '/')) * 1.0 / count(*) AS share FROM calls a JOIN calls b ON a.key = b.key AND a.sample < b.sample GROUP BY 1, 2) SELECT CASE WHEN share >= 0.4 THEN 'close' WHEN share >= 0.3 THEN 'related' WHEN share >= 0.2 THEN 'distant' ELSE 'unrelated' END AS relation, count(*) AS n FROM s GROUP BY 1")
def e20_relationships(spark, sf_dir):
    """Pairs of samples by thresholds of the share of equal genotypes."""
    from . import tools

    share = F.col("same") / F.col("shared")
    relation = F.when(share >= 0.4, "close").when(share >= 0.3, "related").when(share >= 0.2, "distant").otherwise("unrelated")
    return tools.relatedness(spark, sf_dir).groupBy(relation.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@_add(f", h AS (SELECT key, gene, transcript, biotype, term FROM cts WHERE {_LOF}), k AS (SELECT sample, gene, transcript, biotype, term, key, CASE WHEN gt = '1/1' THEN 'HOM_ALT' ELSE 'HET_ALT' END AS kind, filter FROM calls JOIN h USING (key) WHERE gt IN ('1/1', '1|2')) SELECT sample, gene, kind, count(DISTINCT key) AS n FROM k JOIN variants USING (key) WHERE list_contains(filter, 'PASS') AND biotype = 'protein_coding' AND coalesce(freq, 0) < 0.5 GROUP BY 1, 2, 3")
def rga_individuals(spark, sf_dir):
    """Knockouts by sample, gene and kind, restricted by FILTER, biotype and population frequency."""
    v = lens.variants(spark, sf_dir).filter(F.coalesce("freq", F.lit(0.0)) < 0.5).select("key")
    h = lens.consequences(spark, sf_dir).filter(F.col("term").isin(*V.LOF) & (F.col("biotype") == "protein_coding")).join(v, "key", "left_semi")
    c = lens.calls(spark, sf_dir).filter(F.array_contains("filter", "PASS")).withColumn("kind", V.genotype_class(F.col("gt"))).filter("kind IN ('HOM_ALT', 'HET_ALT')")
    return c.join(h, "key").groupBy("sample", "gene", "kind").agg(F.countDistinct("key").alias("n"))


@_add(f", h AS (SELECT DISTINCT key, gene FROM cts WHERE {_LOF}), k AS (SELECT DISTINCT sample, gene FROM calls JOIN h USING (key) WHERE gt = '1/1') SELECT cohort, count(DISTINCT gene) AS n_genes, count(*) AS n FROM k JOIN members USING (sample) GROUP BY 1")
def rga_facet(spark, sf_dir):
    h = lens.consequences(spark, sf_dir).filter(F.col("term").isin(*V.LOF)).select("key", "gene").distinct()
    k = lens.calls(spark, sf_dir).filter("gt = '1/1'").join(h, "key").select("sample", "gene").distinct()
    return k.join(lens.members(spark), "sample").groupBy("cohort").agg(F.countDistinct("gene").alias("n_genes"), F.count(F.lit(1)).alias("n"))


@_add(" SELECT freq IS NOT NULL AS known, CASE WHEN freq IS NULL THEN 'none' WHEN freq <= 0.001 THEN '0.001' WHEN freq <= 0.01 THEN '0.01' WHEN freq <= 0.05 THEN '0.05' WHEN freq <= 0.5 THEN '0.5' ELSE 'more' END AS bucket, count(*) AS n FROM variants GROUP BY 1, 2")
def rga_frequency_buckets(spark, sf_dir):
    """The first threshold that a frequency does not exceed."""
    c = F.col("freq")
    bucket = F.when(c.isNull(), "none").when(c <= 0.001, "0.001").when(c <= 0.01, "0.01").when(c <= 0.05, "0.05").when(c <= 0.5, "0.5").otherwise("more")
    return lens.variants(spark, sf_dir).groupBy(c.isNotNull().alias("known"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@_add(", i AS (SELECT key, 100 AS an, key % 90 AS ac, key % 7 AS hom FROM variants) SELECT key, round(ac / an, 9) AS alt_freq, round(1 - ac / an, 9) AS ref_freq, round(least(ac / an, 1 - ac / an), 9) AS maf, hom FROM i")
def a20_aggregated(spark, sf_dir):
    """Statistics that a file brings along as INFO tags (AN, AC, Hom)."""
    from ..sources import vcf

    lines = lens.variants(spark, sf_dir).select("key", F.concat(F.lit("AN=100;AC="), (F.col("key") % 90).cast("string"), F.lit(";Hom="), (F.col("key") % 7).cast("string")).alias("text"))
    tags = lines.select("key", vcf.info(F.col("text")).alias("i")).select("key", F.col("i")["AN"].cast("long").alias("an"), F.col("i")["AC"].cast("long").alias("ac"), F.col("i")["Hom"].cast("long").alias("hom"))
    freq = F.col("ac") / F.col("an")
    return tags.select("key", F.round(freq, 9).alias("alt_freq"), F.round(1 - freq, 9).alias("ref_freq"), F.round(V.minor(freq), 9).alias("maf"), "hom")


@_add(" SELECT key, string_agg(DISTINCT gene, ',' ORDER BY gene) AS genes, string_agg(DISTINCT gene || '_' || term, ',' ORDER BY gene || '_' || term) AS pairs FROM cts GROUP BY 1")
def x09_search_document(spark, sf_dir):
    """The same of every variant."""
    return _search_documents(lens.consequences(spark, sf_dir))


def _search_documents(rows):
    text = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return rows.groupBy("key").agg(text("gene").alias("genes"), text(F.concat_ws("_", "gene", "term")).alias("pairs"))


@_add(" SELECT key, sample FROM calls WHERE file <> 'file2' AND sample NOT IN (4, 9)")
def x13_delete(spark, sf_dir):
    """What is left after a file and two samples are deleted."""
    gone = spark.range(2).selectExpr("id * 5 + 4 AS sample")
    return lens.calls(spark, sf_dir).filter("file <> 'file2'").join(gone, "sample", "left_anti").select("key", "sample")


@_add(" SELECT chrom, pos // 100 AS win, round(avg(depth), 6) AS mean_depth FROM coverage WHERE chrom = 'chr1' AND pos BETWEEN 200 AND 3000 GROUP BY 1, 2")
def s16_coverage_windows(spark, sf_dir):
    rows = lens.coverage(spark, sf_dir).filter("chrom = 'chr1' AND pos BETWEEN 200 AND 3000")
    return rows.groupBy("chrom", F.expr("pos div 100").alias("win")).agg(F.round(F.avg("depth"), 6).alias("mean_depth"))


@_add(", p AS (SELECT *, lead(start) OVER (PARTITION BY chrom ORDER BY start, key) - start AS gap FROM variants) SELECT chrom, count(*) FILTER (WHERE gap <= 20) AS clustered, max(gap) AS widest FROM p GROUP BY 1")
def w03_gaps(spark, sf_dir):
    from pyspark.sql import Window as W

    gap = F.lead("start").over(W.partitionBy("chrom").orderBy("start", "key")) - F.col("start")
    return lens.variants(spark, sf_dir).withColumn("gap", gap).groupBy("chrom").agg(F.count(F.when(F.col("gap") <= 20, 1)).alias("clustered"), F.max("gap").alias("widest"))


@_add(", a AS (SELECT chrom, start, \"end\" + 500 AS \"end\" FROM variants WHERE type = 'SNV'), b AS (SELECT chrom, start, \"end\" + 500 AS \"end\" FROM variants WHERE type = 'MNV') SELECT count(*) AS n FROM (SELECT DISTINCT chrom, p FROM (SELECT chrom, unnest(range(start, \"end\" + 1)) AS p FROM a) WHERE (chrom, p) IN (SELECT chrom, unnest(range(start, \"end\" + 1)) FROM b))")
def u05_common_positions(spark, sf_dir):
    """The same of all chromosomes."""
    return _common_positions(lens.variants(spark, sf_dir))


def _common_positions(rows):
    rows = rows.withColumn("end", F.col("end") + 500)
    both = overlap.common(rows.filter("type = 'SNV'"), rows.filter("type = 'MNV'"))
    return both.agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).cast("long").alias("n"))


@_add(" SELECT c_custkey AS id, c_acctbal AS balance, CASE WHEN c_custkey % 3 = 0 THEN 'updated' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM customer")
def c02_snapshots(spark, sf_dir):
    """Versions of entities as appended rows; the latest one of each counts."""
    c = lens.read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_acctbal AS balance", "c_mktsegment AS segment", "1 AS version")
    changed = c.filter("id % 3 = 0").withColumns({"segment": F.lit("updated"), "version": F.lit(2)})
    return records.latest(c.unionByName(changed), ["id"], "version")


@_add(f", c AS (SELECT key, sample FROM calls WHERE {_CARRIED}) SELECT key FROM c WHERE sample IN (SELECT sample FROM members WHERE cohort = 'C0') GROUP BY 1 HAVING count(*) >= 2 AND key NOT IN (SELECT key FROM c WHERE sample IN (SELECT sample FROM members WHERE cohort = 'C1'))")
def j03_cohort_contrast(spark, sf_dir):
    """Variants that two samples of one cohort carry and none of another."""
    c = lens.calls(spark, sf_dir).filter(V.carries(F.col("gt"))).join(lens.members(spark), "sample")
    often = c.filter("cohort = 'C0'").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return samples.all_of([often], [c.filter("cohort = 'C1'")])
