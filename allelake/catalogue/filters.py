"""One query for each filter parameter, and for projection, order and count."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lens
from ..functions import variant as V
from ..plans import filters
from ..plans import language as L

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _filter(name: str, params: dict, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: filters.select(lens.variants(spark, sf_dir), lens.tables(spark, sf_dir), params, lens.PEDIGREES, lens.knowledge(spark, sf_dir)).select("key")
    ORACLE_SQL[name] = f"{lens.SQL} SELECT key FROM variants v WHERE {where}"


def _ct(where: str) -> str:
    return f"EXISTS (SELECT 1 FROM cts c WHERE c.key = v.key AND {where})"


def _call(where: str) -> str:
    return f"EXISTS (SELECT 1 FROM calls c WHERE c.key = v.key AND {where})"


def _evidence(where: str) -> str:
    return f"EXISTS (SELECT 1 FROM evidence e WHERE e.key = v.key AND {where})"


_filter("f01_id", {"id": "rs400,rs404,3:7920:C:G,rs8"}, "rs IN ('rs400', 'rs404', 'rs8') OR (chrom = '3' AND start = 7920 AND reference = 'C' AND alternate = 'G')")
_filter("f02_region_overlap", {"region": "chr1:100000-200000,1:150000-260000,X,22:1-50000,7"}, "(chrom = '1' AND \"end\" >= 100000 AND start <= 260000) OR chrom IN ('X', '7') OR (chrom = '22' AND \"end\" >= 1 AND start <= 50000)")
_filter("f02_region_start", {"region": "1:100000-200000,5:300000-", "regionStartOnly": True}, "(chrom = '1' AND start BETWEEN 100000 AND 200000) OR (chrom = '5' AND start >= 300000)")
_MANY = [(str(k % 22 + 1), k * 7001 % 900000, k * 7001 % 900000 + 3000) for k in range(60)]
_filter("f02_region_many", {"region": ",".join(f"{c}:{s}-{e}" for c, s, e in _MANY)}, " OR ".join(f"(chrom = '{c}' AND \"end\" >= {s} AND start <= {e})" for c, s, e in _MANY))
_filter("f03_reference", {"reference": "A,C"}, "reference IN ('A', 'C')")
_filter("f04_alternate", {"alternate": "!T;!G"}, "alternate NOT IN ('T', 'G')")
_filter("f05_type", {"type": "INDEL"}, "type IN ('INDEL', 'INSERTION', 'DELETION')")
_filter("f05_type_not", {"type": "!INDEL,!MNV"}, "type NOT IN ('INDEL', 'INSERTION', 'DELETION', 'MNV')")
_filter("f06_study", {"study": "SO,SP"}, "study IN ('SO', 'SP')")
_filter("f06_study_not", {"study": "!SO"}, "study <> 'SO'")
_ALT = "list_contains(string_split_regex(gt, '[/|]'), '1')"
_filter("f07_sample_all", {"sample": "1;2"}, f"{_call(f'sample = 1 AND {_ALT}')} AND {_call(f'sample = 2 AND {_ALT}')}")
_filter("f07_sample_any_not", {"sample": "3;!4"}, f"{_call(f'sample = 3 AND {_ALT}')} AND NOT {_call(f'sample = 4 AND {_ALT}')}")
_filter("f08_genotype", {"genotype": "1:0/1,1/1;2:2/1"}, f"{_call("sample = 1 AND gt IN ('0/1', '1/0', '0|1', '1|0', '1/1', '1|1')")} AND {_call("sample = 2 AND gt IN ('2/1', '1/2', '2|1', '1|2')")}")
_filter("f08_genotype_any_second_alternate", {"genotype": "2:1/3,0/0"}, _call("sample = 2 AND (gt = '0/0' OR regexp_full_match(gt, '(1[/|]([2-9]|[1-9][0-9]+))|(([2-9]|[1-9][0-9]+)[/|]1)'))"))
_filter("f07_sample_names", {"sample": "NA12801;!NA12802"}, f"{_call(f'sample = 1 AND {_ALT}')} AND NOT {_call(f'sample = 2 AND {_ALT}')}")
_filter("f07_sample_genotypes", {"sample": "NA12803:0/1;NA12805:HOM_ALT"}, f"{_call("sample = 3 AND gt IN ('0/1', '1/0', '0|1', '1|0')")} AND {_call("sample = 5 AND gt IN ('1/1', '1|1')")}")
_filter("f09_sample_data_names", {"sampleData": "12:dp>20,gq>=60;NA12813:dp>5"}, f"{_call('sample = 12 AND (dp > 20 OR gq >= 60)')} AND {_call('sample = 13 AND dp > 5')}")
_filter("f09_sample_data_genotype", {"sampleData": "4:GT=1/1;dp>=10"}, _call("sample = 4 AND gt IN ('1/1', '1|1') AND dp >= 10"))
_filter("f11_file_data_names", {"fileData": "file1:FILTER=LowQ,qual>60;file2:qual<=20"}, f"{_call("file = 'file1' AND (list_contains(filter, 'LowQ') OR qual > 60)")} AND {_call("file = 'file2' AND qual <= 20")}")
_filter("f08_genotype_class", {"genotype": "5:HOM_ALT,HET_ALT"}, _call("sample = 5 AND gt IN ('1/1', '1|2')"))
_filter("f08_genotype_not", {"genotype": "5:!0/1,!1/1"}, f"NOT {_call("sample = 5 AND gt IN ('0/1', '1/0', '0|1', '1|0', '1/1', '1|1')")}")
_filter("f09_sample_data", {"sampleData": "1:dp>30;gq<90"}, _call("sample = 1 AND dp > 30 AND gq < 90"))
_filter("f09_sample_data_missing", {"sampleData": "2:gq!=50"}, _call("sample = 2 AND gq <> 50"))
_filter("f10_file", {"file": "file1;!file2"}, f"{_call("file = 'file1'")} AND NOT {_call("file = 'file2'")}")
_filter("f11_file_data", {"fileData": "file3:filter=PASS;qual>40"}, _call("file = 'file3' AND list_contains(filter, 'PASS') AND qual > 40"))
_filter("f12_filter", {"filter": "LowQ,LowGQX"}, _call("(list_contains(filter, 'LowQ') OR list_contains(filter, 'LowGQX'))"))
_filter("f12_filter_not", {"filter": "!PASS"}, _call("NOT list_contains(filter, 'PASS')"))
_filter("f13_qual", {"qual": ">60"}, _call("qual > 60"))
_filter("f21_score", {"functionalScore": "cadd_scaled>=20;cadd_scaled<30"}, "cadd >= 20 AND cadd < 30")
_filter("f22_frequency_alt", {"populationFrequencyAlt": "S:ALL<0.1"}, "coalesce(freq, 0) < 0.1")
_filter("f22_frequency_ref", {"populationFrequencyRef": "S:ALL>=0.95"}, "1 - coalesce(freq, 0) >= 0.95")
_filter("f22_frequency_maf", {"populationFrequencyMaf": "S:ALL>0.4"}, "least(coalesce(freq, 0), 1 - coalesce(freq, 0)) > 0.4")
_filter("f22_frequency_populations", {"populationFrequencyAlt": "S:ALL<0.1;1000G:ALL<0.2"}, "coalesce(freq, 0) < 0.1 AND coalesce(freq2, 0) < 0.2")
_filter("f22_frequency_unknown", {"populationFrequencyAlt": "GNOMAD:AFR<=0", "type": "SNV"}, "type = 'SNV'")
_filter("f21_variant_score", {"score": "gwas1>=0.5"}, "gwas1 >= 0.5")
_filter("f21_variant_score_missing", {"score": "gwas1<<0.1"}, "gwas1 IS NULL OR gwas1 < 0.1")
_filter("f31_conservation_sources", {"conservation": "phylop>0.5;gerp<=3"}, "phylop > 0.5 AND gerp <= 3")
_filter("f32_functional_raw", {"functionalScore": "cadd_raw>=8,cadd_scaled>38"}, "cadd_raw >= 8 OR cadd > 38")
_filter("f30_polyphen", {"proteinSubstitution": "polyphen>0.9;sift<0.1"}, f"{_ct('polyphen > 0.9')} AND {_ct('sift < 0.1')}")
_filter("f30_polyphen_text", {"proteinSubstitution": "polyphen=probably damaging"}, _ct("polyphen >= 0.91"))
_filter("f30_legacy", {"polyphen": "<0.2", "sift": "tolerated"}, f"{_ct('polyphen < 0.2')} AND {_ct('sift >= 0.05')}")
_filter("f34_gene_trait", {"geneTraitId": "OMIM:1"}, "key % 8 = 0")
_filter("f34_gene_trait_name", {"geneTraitName": "short stature;!Marfan syndrome"}, "key % 8 = 1")
_filter("f34_hpo", {"hpo": "HP:0001"}, "key % 8 IN (0, 1)")
_filter("f38_drug", {"drug": "tamoxifen"}, "key % 9 = 4")
_filter("f38_protein_keyword", {"proteinKeyword": "Kinase;!Membrane"}, "key % 10 = 0")
_filter("f39_custom_number", {"customAnnotation": "depth>=40"}, "key % 4 <> 1 AND key % 50 >= 40")
_filter("f39_custom_text", {"customAnnotation": "class=K3,depth<2"}, "key % 5 = 3 OR (key % 4 <> 1 AND key % 50 < 2)")
_filter("f41_source", {"source": "secondary_sample_index", "sample": "6"}, _call(f"sample = 6 AND {_ALT}"))
_filter("f42_legacy_sources", {"clinvar": "clinvar", "cosmic": "cosmic"}, f"{_evidence("source = 'clinvar'")} AND {_evidence("source = 'cosmic'")}")
_filter("f24_xref_traits", {"xref": "HP:0001;!G17"}, f"key % 8 IN (0, 1) AND NOT {_ct("gene = 'G17'")}")
_COHORTS = ", s AS (SELECT key, cohort, count(*) AS n, sum(len(list_filter(string_split_regex(gt, '[/|]'), lambda x: x = '1'))) / 10.0 AS alt, 1 - sum(len(list_filter(string_split_regex(gt, '[/|]'), lambda x: x NOT IN ('0', '.')))) / 10.0 AS ref, least(5 - count(*) + count(*) FILTER (WHERE gt = '0/0'), count(*) FILTER (WHERE gt = '0/1'), count(*) FILTER (WHERE gt = '1/1')) / 5.0 AS mgf, count(*) FILTER (WHERE list_contains(filter, 'PASS')) / CAST(count(*) AS DOUBLE) AS pass FROM calls JOIN members USING (sample) GROUP BY 1, 2)"


def _cohort(where: str) -> str:
    return f"EXISTS (SELECT 1 FROM s WHERE s.key = v.key AND {where})"


def _cohort_filter(name: str, params: dict, where: str) -> None:
    _filter(name, params, where)
    ORACLE_SQL[name] = f"{lens.SQL}{_COHORTS} SELECT key FROM variants v WHERE {where}"


_cohort_filter("f14_cohort", {"cohort": "SO:C1;!C2"}, f"study = 'SO' AND {_cohort("cohort = 'C1'")} AND NOT {_cohort("cohort = 'C2'")}")
_cohort_filter("f15_cohort_ref", {"cohortStatsRef": "C1<0.85"}, _cohort("cohort = 'C1' AND ref < 0.85"))
_cohort_filter("f16_cohort_alt", {"cohortStatsAlt": "SF:C3>=0.15;C0<<0.25"}, f"study = 'SF' AND {_cohort("cohort = 'C3' AND alt >= 0.15")} AND ({_cohort("cohort = 'C0' AND alt < 0.25")} OR NOT {_cohort("cohort = 'C0'")})")
_cohort_filter("f17_cohort_minor", {"cohortStatsMaf": "C2>0.15"}, _cohort("cohort = 'C2' AND least(alt, ref) > 0.15"))
_cohort_filter("f18_cohort_minor_genotype", {"cohortStatsMgf": "C0>0"}, _cohort("cohort = 'C0' AND mgf > 0"))
_cohort_filter("f19_cohort_pass", {"cohortStatsPass": "C1>=0.5,C2>=0.9"}, f"{_cohort("cohort = 'C1' AND pass >= 0.5")} OR {_cohort("cohort = 'C2' AND pass >= 0.9")}")
_cohort_filter("f20_missing_alleles", {"missingAlleles": "C3<=6"}, _cohort("cohort = 'C3' AND 10 - 2 * n <= 6"))
_cohort_filter("f20_missing_genotypes", {"missingGenotypes": "C0<4;C1<5"}, f"{_cohort("cohort = 'C0' AND 5 - n < 4")} AND {_cohort("cohort = 'C1' AND 5 - n < 5")}")


def _gene_set(where: str) -> str:
    return _ct(f"CAST(substr(gene, 2) AS INT) IN (SELECT p_partkey % 300 FROM part) AND {where}")


_NUMBER = "CAST(substr(gene, 2) AS INT)"
_filter("f37_go", {"go": "GO:2,GO:5", "type": "SNV"}, f"type = 'SNV' AND {_gene_set(f'{_NUMBER} % 7 IN (2, 5)')}")
_filter("f37_expression", {"expression": "tissue3", "ct": "stop_gained"}, f"{_gene_set(f'{_NUMBER} % 5 = 3')} AND {_ct("term = 'stop_gained'")}")
_filter("f37_role_in_cancer", {"geneRoleInCancer": "TSG"}, _gene_set(f"{_NUMBER} % 11 = 0"))
_filter("f37_no_genes", {"go": "GO:99", "type": "SNV"}, "type = 'none'")
_filter("f44_panel", {"panel": "panel4", "filter": "PASS"}, f"{_gene_set(f'{_NUMBER} % 13 = 4')} AND {_call("list_contains(filter, 'PASS')")}")
_filter("f44_family", {"family": "trio1"}, _call(f"sample IN (3, 4, 5) AND {_ALT}"))


def _role(sample: int, *classes: str) -> str:
    held = _call(f"sample = {sample} AND {_CLASS} IN ({', '.join(f"'{c}'" for c in classes)})")
    return f"({held} OR NOT {_call(f'sample = {sample}')})" if "HOM_REF" in classes else held


_CLASS = "CASE gt WHEN '0/0' THEN 'HOM_REF' WHEN '1/1' THEN 'HOM_ALT' WHEN '0/1' THEN 'HET_REF' ELSE 'HET_ALT' END"
_filter("f44_segregation_recessive", {"family": "trio0", "familySegregation": "autosomalRecessive"}, f"{_role(0, 'HOM_ALT')} AND {_role(1, 'HET_REF')} AND {_role(2, 'HET_REF')}")
_filter("f07_sample_mode_dominant", {"sample": "3:AUTOSOMAL_DOMINANT"}, f"{_role(3, 'HET_REF', 'HOM_ALT')} AND {_role(4, 'HOM_REF')} AND {_role(5, 'HET_REF', 'HOM_ALT')}")
_filter("f07_sample_mode_de_novo", {"sample": "6:deNovoStrict,9:deNovoStrict"}, " OR ".join(f"({_role(c, 'HET_REF', 'HET_ALT', 'HOM_ALT')} AND {_role(c + 1, 'HOM_REF')} AND {_role(c + 2, 'HOM_REF')})" for c in (6, 9)))
_filter("f27_ct_number", {"ct": "1583,SO:0001587"}, _ct("term IN ('missense_variant', 'stop_gained')"))
_filter("f23_annotated", {"annotationExists": "false"}, "NOT EXISTS (SELECT 1 FROM cts c WHERE c.key = v.key)")
_filter("f24_xref", {"xref": "rs12,G17,cosmic"}, f"coalesce(rs = 'rs12', FALSE) OR {_ct("gene = 'G17'")} OR {_evidence("source = 'cosmic'")}")
_filter("f25_gene", {"gene": "G5,G6"}, _ct("gene IN ('G5', 'G6')"))
_filter("f26_biotype", {"biotype": "protein_coding"}, _ct("biotype = 'protein_coding'"))
_filter("f27_ct_alias", {"ct": "lof"}, _ct("term IN ('stop_gained', 'frameshift_variant', 'splice_donor_variant')"))
_filter("f27_ct_accession", {"ct": "SO:0001583"}, _ct("term = 'missense_variant'"))
_filter("f28_same_transcript", {"gene": "G5,G6,G7,G8", "ct": "pa", "biotype": "protein_coding", "transcriptFlag": "canonical"}, _ct("gene IN ('G5', 'G6', 'G7', 'G8') AND term IN ('missense_variant', 'stop_gained', 'frameshift_variant', 'splice_donor_variant') AND biotype = 'protein_coding' AND flag = 'canonical'"))
_filter("f29_region_or_gene", {"region": "2:1-200000", "gene": "G9", "ct": "missense_variant"}, f"(chrom = '2' AND \"end\" >= 1 AND start <= 200000 AND {_ct("term = 'missense_variant'")}) OR {_ct("gene = 'G9' AND term = 'missense_variant'")}")
_filter("f30_substitution", {"proteinSubstitution": "sift<0.05"}, _ct("sift < 0.05"))
_filter("f30_substitution_text", {"proteinSubstitution": "sift=deleterious"}, _ct("sift < 0.05"))
_filter("f31_conservation", {"conservation": "phastCons<<0.2"}, "phastcons IS NULL OR phastcons < 0.2")
_filter("f32_functional", {"functionalScore": "cadd_scaled!=10"}, "cadd IS NULL OR cadd <> 10")
_filter("f32_inherited_operator", {"functionalScore": "cadd_scaled>35,2"}, "cadd > 35 OR cadd > 2")
_filter("f33_flag", {"transcriptFlag": "basic"}, _ct("flag = 'basic'"))
_filter("f35_trait", {"trait": "cancer"}, "coalesce(contains(trait, 'cancer'), FALSE)")
_filter("f36_clinical", {"clinical": "clinvar", "clinicalSignificance": "pathogenic,Likely Pathogenic", "clinicalConfirmedStatus": "true"}, _evidence("source = 'clinvar' AND significance IN ('pathogenic', 'likely_pathogenic') AND status = 'confirmed'"))
_filter("f36_clinical_sources", {"clinical": "clinvar,cosmic", "clinicalSignificance": "pathogenic"}, f"{_evidence("source = 'clinvar' AND significance = 'pathogenic'")} AND {_evidence("source = 'cosmic' AND significance = 'pathogenic'")}")
_filter("f40_release", {"release": "2"}, "release <= 2")
_filter("f00_combined", {"type": "SNV", "region": "1,2,3,4,5", "filter": "PASS", "sample": "1,2,3", "functionalScore": "cadd_scaled>5"}, f"type = 'SNV' AND chrom IN ('1', '2', '3', '4', '5') AND {_call("list_contains(filter, 'PASS')")} AND {_call(f'sample IN (1, 2, 3) AND {_ALT}')} AND cadd > 5")

_OPS = ("=", "==", "!=", "<", "<=", ">", ">=", "<<", "<<=", ">>", ">>=")


def f00_null_semantics(spark, sf_dir):
    """How many variants each comparison holds for; missing scores only under != and the doubled operators."""
    rows = lens.variants(spark, sf_dir)
    sums = rows.agg(*(F.count(F.when(V.compare(F.col("cadd"), op, 20.0), 1)).alias(f"c{i}") for i, op in enumerate(_OPS)))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(op).alias("op"), F.col(f"c{i}").alias("n")) for i, op in enumerate(_OPS)))))


QUERIES["f00_null_semantics"] = f00_null_semantics
_SQL_OP = {"==": "=", "!=": "<>", "<<": "<", "<<=": "<=", ">>": ">", ">>=": ">="}
ORACLE_SQL["f00_null_semantics"] = lens.SQL + " UNION ALL ".join(f"SELECT '{op}' AS op, count(*) AS n FROM variants WHERE cadd {_SQL_OP.get(op, op)} 20" + (" OR cadd IS NULL" if op == "!=" or op[:2] in ("<<", ">>") else "") for op in _OPS)


def f46_reads(spark, sf_dir):
    """Line items as reads: least mapping quality, most mismatches, flags unset, contained in a region."""
    reads = lens.read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS part", "CAST(l_quantity AS INT) AS mapq", "l_partkey % 8 AS flag", "l_suppkey % 5 AS mismatches", "(l_orderkey * 7919) % 1000000 + 1 AS start")
    keep = (F.col("mapq") >= 20) & (F.col("mismatches") <= 2) & (F.col("flag").bitwiseAND(4) == 0) & (F.col("start") >= 1000) & (F.col("start") + 99 <= 500000)
    return reads.filter(keep).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("mapq").cast("long").alias("mapq"))


QUERIES["f46_reads"] = f46_reads
ORACLE_SQL["f46_reads"] = "SELECT l_linenumber AS part, count(*) AS n, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS mapq FROM lineitem WHERE CAST(l_quantity AS INT) >= 20 AND l_suppkey % 5 <= 2 AND ((l_partkey % 8) & 4) = 0 AND (l_orderkey * 7919) % 1000000 + 1 >= 1000 AND (l_orderkey * 7919) % 1000000 + 100 <= 500000 GROUP BY 1"


def f47_catalogue(spark, sf_dir):
    """Entities by status, value and pattern: customers as individuals."""
    rows = lens.read(spark, sf_dir, "customer")
    return rows.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & V.row_compare(F.col("c_name"), "=~", "0[1-5]$") & V.row_compare(F.col("c_acctbal"), ">", "0")).select("c_custkey", "c_name")


QUERIES["f47_catalogue"] = f47_catalogue
ORACLE_SQL["f47_catalogue"] = "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND regexp_matches(c_name, '0[1-5]$') AND c_acctbal > 0"


def f48_annotation_sets(spark, sf_dir):
    """Typed variables of a nested annotation: a number out of JSON, by event type."""
    rows = lens.read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    return rows.filter((F.col("k") >= 50) & F.col("event_type").isin("purchase", "click")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


QUERIES["f48_annotation_sets"] = f48_annotation_sets
ORACLE_SQL["f48_annotation_sets"] = "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events WHERE event_type IN ('purchase', 'click') AND CAST(json_extract_string(props, '$.k') AS INT) >= 50 GROUP BY 1, 2"


def p06_page(spark, sf_dir):
    """The second page of SNVs in locus order."""
    return filters.query(lens.variants(spark, sf_dir), {"type": "SNV"}, limit=50, skip=50).select("key", "chrom", "start")


QUERIES["p06_page"] = p06_page
ORACLE_SQL["p06_page"] = lens.SQL + "SELECT key, chrom, start FROM variants WHERE type = 'SNV' ORDER BY lpad(chrom, 2, '0'), start, \"end\", reference, alternate, key LIMIT 50 OFFSET 50"


def p02_projection(spark, sf_dir):
    """Two samples' genotypes, unknown ones as ./. , for variants of one region."""
    rows = filters.query(lens.wide(spark, sf_dir, ("calls",)), {"region": "3:1-300000"})
    gt = lambda s: F.coalesce(F.get(F.filter("calls", lambda c: c["sample"] == s), 0)["gt"], F.lit("./.")).alias(f"gt_{s}")
    return rows.select("key", gt(1), gt(2))


QUERIES["p02_projection"] = p02_projection
ORACLE_SQL["p02_projection"] = lens.SQL + "SELECT v.key, coalesce(max(CASE WHEN sample = 1 THEN gt END), './.') AS gt_1, coalesce(max(CASE WHEN sample = 2 THEN gt END), './.') AS gt_2 FROM variants v LEFT JOIN calls c ON c.key = v.key WHERE chrom = '3' AND \"end\" >= 1 AND start <= 300000 GROUP BY 1"


def p04_sample_page(spark, sf_dir):
    """Of each variant the third and fourth sample in order."""
    rows = lens.wide(spark, sf_dir, ("calls",))
    page = F.slice(F.array_sort(F.transform("calls.sample", lambda s: s)), 3, 2)
    return rows.select("key", F.explode(page).alias("sample"))


QUERIES["p04_sample_page"] = p04_sample_page
ORACLE_SQL["p04_sample_page"] = lens.SQL + "SELECT key, sample FROM (SELECT key, sample, row_number() OVER (PARTITION BY key ORDER BY sample) AS rn FROM calls) WHERE rn IN (3, 4)"


def p08_count(spark, sf_dir):
    """Exact counts of several filters at once."""
    rows = lens.variants(spark, sf_dir)
    tests = {"snv": {"type": "SNV"}, "chr1": {"region": "1"}, "rare": {"populationFrequencyAlt": "S:ALL<0.05"}}
    return rows.agg(*(F.count(F.when(filters.condition(p), 1)).alias(n) for n, p in tests.items()))


QUERIES["p08_count"] = p08_count
ORACLE_SQL["p08_count"] = lens.SQL + "SELECT count(*) FILTER (WHERE type = 'SNV') AS snv, count(*) FILTER (WHERE chrom = '1') AS chr1, count(*) FILTER (WHERE coalesce(freq, 0) < 0.05) AS rare FROM variants"


def p11_extrapolated(spark, sf_dir):
    """A count extrapolated from one chromosome's share."""
    rows = lens.variants(spark, sf_dir).filter(filters.condition({"type": "INDEL"}))
    return rows.agg(F.count(F.when(F.col("chrom") == "1", 1)).alias("n_chr1")).select("n_chr1", (F.col("n_chr1") * 12.5).cast("long").alias("estimate"))


QUERIES["p11_extrapolated"] = p11_extrapolated
ORACLE_SQL["p11_extrapolated"] = lens.SQL + "SELECT n_chr1, CAST(floor(n_chr1 * 12.5) AS BIGINT) AS estimate FROM (SELECT count(*) AS n_chr1 FROM variants WHERE chrom = '1' AND type IN ('INDEL', 'INSERTION', 'DELETION'))"


def p14_sample_data(spark, sf_dir):
    """Calls of variants in a region that carry the main alternate, in order of samples."""
    rows = lens.calls(spark, sf_dir).join(lens.variants(spark, sf_dir).filter(filters.region_condition([L.region("4:1-100000")])).select("key"), "key", "left_semi")
    return rows.filter(V.carries(F.col("gt"))).select("key", "sample", "gt", "file")


QUERIES["p14_sample_data"] = p14_sample_data
ORACLE_SQL["p14_sample_data"] = lens.SQL + f"SELECT key, sample, gt, file FROM calls WHERE {_ALT} AND key IN (SELECT key FROM variants WHERE chrom = '4' AND \"end\" >= 1 AND start <= 100000)"
