"""Analyses: association, knockouts, signatures, sex, tiers, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lens
from ..functions import variant as V
from ..operators import families, samples, stats

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_ALT = "len(list_filter(string_split_regex(gt, '[/|]'), lambda a: a = '1'))"


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


_TABLE = f", t AS (SELECT key, CAST(sum(CASE WHEN sample < 8 THEN {_ALT} ELSE 0 END) AS BIGINT) AS d, CAST(sum(CASE WHEN sample < 8 THEN 0 ELSE {_ALT} END) AS BIGINT) AS e FROM calls GROUP BY 1), g AS (SELECT key, 16 - d AS case_ref, 24 - e AS control_ref, d AS case_alt, e AS control_alt FROM t WHERE d + e > 0)"


@_add(lens.SQL + _TABLE + ", k AS (SELECT DISTINCT case_ref AS a, control_ref AS b, case_alt AS c, control_alt AS d FROM g), x AS (SELECT *, unnest(range(greatest(0, a + b + a + c - 40), least(a + b, a + c) + 1)) AS i FROM k), lt AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(41) - lgamma(i + 1) - lgamma(a + b - i + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) AS term FROM x), p AS (SELECT a, b, c, d, sum(exp(term)) FILTER (WHERE term <= here + 1e-7) AS p FROM (SELECT *, max(CASE WHEN i = a THEN term END) OVER (PARTITION BY a, b, c, d) AS here FROM lt) GROUP BY 1, 2, 3, 4) SELECT key, case_ref, control_ref, case_alt, control_alt, round(least(p, 1), 6) AS p_value, round(case_ref * control_alt / nullif(control_ref * case_alt, 0), 6) AS odds_ratio FROM g JOIN p ON a = case_ref AND b = control_ref AND c = case_alt AND d = control_alt")
def gwas_fisher(spark, sf_dir):
    table = stats.allele_tables(lens.calls(spark, sf_dir), F.col("sample") < 8, 20, 8)
    return stats.fisher(table).select("key", "case_ref", "control_ref", "case_alt", "control_alt", F.round("p_value", 6).alias("p_value"), F.round("odds_ratio", 6).alias("odds_ratio"))


_TRIO = ", r AS (SELECT trio, unnest(['child', 'father', 'mother']) AS role, unnest([child, father, mother]) AS sample FROM trios), t AS (SELECT key, trio, coalesce(max(CASE WHEN role = 'child' THEN gt END), '0/0') AS child, coalesce(max(CASE WHEN role = 'father' THEN gt END), '0/0') AS father, coalesce(max(CASE WHEN role = 'mother' THEN gt END), '0/0') AS mother FROM calls JOIN r USING (sample) GROUP BY 1, 2)"
_HAS = "list_contains(string_split_regex({0}, '[/|]'), '1')"


@_add(lens.SQL + _TRIO + ", h AS (SELECT DISTINCT key, gene FROM cts WHERE term IN ('stop_gained', 'frameshift_variant', 'splice_donor_variant')), k AS (SELECT sample, gene, count(*) FILTER (WHERE gt = '1/1') AS hom_alt, count(*) FILTER (WHERE gt = '1|2') AS het_alt FROM calls JOIN h USING (key) GROUP BY 1, 2), p AS (SELECT trios.child AS sample, gene, count(*) FILTER (WHERE " + _HAS.format("t.father") + ") * count(*) FILTER (WHERE NOT " + _HAS.format("t.father") + ") AS n FROM t JOIN h USING (key) JOIN trios USING (trio) WHERE t.child = '0/1' AND (" + _HAS.format("t.father") + ") <> (" + _HAS.format("t.mother") + ") GROUP BY 1, 2) SELECT k.sample, k.gene, hom_alt, het_alt, coalesce(n, 0) AS comp_het FROM k LEFT JOIN p ON p.sample = k.sample AND p.gene = k.gene WHERE hom_alt + het_alt + coalesce(n, 0) > 0")
def knockout_by_sample(spark, sf_dir):
    return families.knockouts(lens.calls(spark, sf_dir), lens.consequences(spark, sf_dir), V.LOF, lens.trios(spark))


@_add(lens.SQL + ", h AS (SELECT DISTINCT key, gene FROM cts WHERE term IN ('stop_gained', 'frameshift_variant', 'splice_donor_variant')) SELECT gene, count(DISTINCT sample) AS n_samples, count(*) AS n_variants FROM calls JOIN h USING (key) WHERE gt = '1/1' GROUP BY 1")
def knockout_by_gene(spark, sf_dir):
    hit = lens.consequences(spark, sf_dir).filter(F.col("term").isin(*V.LOF)).select("key", "gene").distinct()
    rows = lens.calls(spark, sf_dir).filter(V.genotype_class(F.col("gt")) == "HOM_ALT").join(hit, "key")
    return rows.groupBy("gene").agg(F.countDistinct("sample").alias("n_samples"), F.count(F.lit(1)).alias("n_variants"))


@_add(lens.SQL + ", x AS (SELECT *, substr('ACGT', CAST(key % 4 + 1 AS INT), 1) AS l, substr('ACGT', CAST(key // 4 % 4 + 1 AS INT), 1) AS r FROM variants WHERE type = 'SNV') SELECT CASE WHEN reference IN ('A', 'G') THEN translate(r, 'ACGT', 'TGCA') || '[' || translate(reference, 'ACGT', 'TGCA') || '>' || translate(alternate, 'ACGT', 'TGCA') || ']' || translate(l, 'ACGT', 'TGCA') ELSE l || '[' || reference || '>' || alternate || ']' || r END AS context, count(*) AS n FROM x GROUP BY 1")
def signature_contexts(spark, sf_dir):
    rows = lens.variants(spark, sf_dir).filter("type = 'SNV'")
    base = lambda e: F.expr(f"substr('ACGT', CAST({e} % 4 + 1 AS INT), 1)")
    return rows.groupBy(V.substitution_key(base("key"), F.col("reference"), base("(key div 4)"), F.col("alternate")).alias("context")).agg(F.count(F.lit(1)).alias("n"))


@_add("SELECT user_id, CASE WHEN x > 0.75 AND y < 0.1 THEN 'XX' WHEN x <= 0.75 AND y >= 0.25 THEN 'XY' WHEN x > 0.75 AND y >= 0.25 THEN 'XXY' WHEN x <= 0.75 AND y < 0.1 THEN 'X0' ELSE 'UNKNOWN' END AS sex FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS x, count(*) FILTER (WHERE event_type = 'signup') / (2 * nullif(count(*) FILTER (WHERE event_type = 'view'), 0)) AS y FROM events GROUP BY 1)")
def e19_sex(spark, sf_dir):
    n = lambda t: F.count(F.when(F.col("event_type") == t, 1)).cast("double")
    rows = lens.read(spark, sf_dir, "events").groupBy("user_id").agg(F.try_divide(n("click"), n("view")).alias("x_ratio"), F.try_divide(n("signup"), 2 * n("view")).alias("y_ratio"))
    return families.inferred_sex(rows).select("user_id", "sex")


@_add(lens.SQL + "SELECT key, CASE WHEN gene IN ('G1', 'G2', 'G3', 'G4', 'G5') AND term IN ('stop_gained', 'frameshift_variant', 'splice_donor_variant') THEN 'TIER1' WHEN gene IN ('G1', 'G2', 'G3', 'G4', 'G5') AND term = 'missense_variant' THEN 'TIER2' WHEN term IN ('stop_gained', 'frameshift_variant', 'splice_donor_variant') THEN 'TIER3' ELSE 'UNTIERED' END AS tier, count(*) AS n FROM cts GROUP BY 1, 2")
def tiering(spark, sf_dir):
    """The tiers of every variant."""
    return _tiers(lens.consequences(spark, sf_dir))


def _tiers(rows):
    panel = F.col("gene").isin("G1", "G2", "G3", "G4", "G5")
    lof = F.col("term").isin(*V.LOF)
    tier = F.when(panel & lof, "TIER1").when(panel & (F.col("term") == "missense_variant"), "TIER2").when(lof, "TIER3").otherwise("UNTIERED")
    return rows.groupBy("key", tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@_add(lens.SQL + "SELECT chrom, start // 250000 AS track, count(*) FILTER (WHERE type = 'SNV') AS snv, count(*) FILTER (WHERE type IN ('INDEL', 'INSERTION', 'DELETION')) AS indel, count(*) FILTER (WHERE cadd > 20) AS scored FROM variants GROUP BY 1, 2")
def circos_tracks(spark, sf_dir):
    rows = lens.variants(spark, sf_dir)
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("chrom", F.expr("start div 250000").alias("track")).agg(n(F.col("type") == "SNV").alias("snv"), n(F.col("type").isin("INDEL", "INSERTION", "DELETION")).alias("indel"), n(F.col("cadd") > 20).alias("scored"))


@_add(lens.SQL + "SELECT a.sample AS a, b.sample AS b, count(*) AS shared, count(*) FILTER (WHERE replace(a.gt, '|', '/') = replace(b.gt, '|', '/')) AS same FROM calls a JOIN calls b ON a.key = b.key AND a.sample < b.sample GROUP BY 1, 2")
def relatedness(spark, sf_dir):
    """Of each pair of samples, variants called in both and with equal genotypes."""
    return samples.pair_counts(lens.calls(spark, sf_dir).select("key", "sample", V.unphased(F.col("gt")).alias("gt")))
