"""A genomic reading of the driver's order tables, so that every operator has variants, calls and annotation to work on.

orders are variants, lineitem holds calls and consequences, events hold depths; the docstrings tell what a row is. All
columns come from integer arithmetic, and nulls are put in on purpose.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .operators import stats as cohorts

TYPE = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'SNV' WHEN '2' THEN 'INDEL' WHEN '3' THEN 'INSERTION' WHEN '4' THEN 'DELETION' ELSE 'MNV' END"
TERM = "CASE l_partkey % 6 WHEN 0 THEN 'missense_variant' WHEN 1 THEN 'stop_gained' WHEN 2 THEN 'synonymous_variant' WHEN 3 THEN 'intron_variant' WHEN 4 THEN 'frameshift_variant' ELSE 'splice_donor_variant' END"
BIOTYPE = "CASE l_linenumber % 3 WHEN 0 THEN 'protein_coding' WHEN 1 THEN 'lincRNA' ELSE 'pseudogene' END"
GENOTYPE = "CASE WHEN l_returnflag = 'R' THEN '1/1' WHEN l_returnflag = 'A' THEN '0/1' WHEN l_linestatus = 'O' THEN '0/0' ELSE '1|2' END"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a variant: locus, alleles, type and single-valued annotation."""
    rows = read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS key",
        "CAST(o_custkey % 22 + 1 AS STRING) AS chrom",
        "(o_orderkey * 7919) % 1000000 + 1 AS start",
        "substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1) AS reference",
        "substr('ACGT', CAST((o_orderkey + 1 + o_orderkey % 3) % 4 + 1 AS INT), 1) AS alternate",
        f"{TYPE} AS type",
        "o_orderkey % 4 + 1 AS release",
        "concat('S', o_orderstatus) AS study",
        "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey * 37 % 400 AS DOUBLE) / 10 END AS cadd",
        "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey * 13 % 1000 AS DOUBLE) / 1000 END AS freq",
        "CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey * 29 % 1000 AS DOUBLE) / 1000 END AS phastcons",
        "CASE o_orderkey % 6 WHEN 0 THEN 'asthma' WHEN 1 THEN 'breast cancer' WHEN 2 THEN 'ovarian cancer' END AS trait",
        "CASE WHEN o_orderkey % 4 = 0 THEN concat('rs', o_orderkey) END AS rs",
        "map('S:ALL', CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey * 13 % 1000 AS DOUBLE) / 1000 END, '1000G:ALL', CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey * 17 % 1000 AS DOUBLE) / 1000 END) AS pops",
        "map('cadd_scaled', CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey * 37 % 400 AS DOUBLE) / 10 END, 'cadd_raw', CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey * 41 % 100 AS DOUBLE) / 10 END) AS functional",
        "map('phastCons', CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey * 29 % 1000 AS DOUBLE) / 1000 END, 'phylop', CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey * 23 % 1000 AS DOUBLE) / 1000 END, 'gerp', CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey * 19 % 120 AS DOUBLE) / 10 END) AS conserved",
        "map('gwas1', CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey * 11 % 1000 AS DOUBLE) / 1000 END) AS scores",
        "map('depth', CASE WHEN o_orderkey % 4 <> 1 THEN CAST(o_orderkey % 50 AS STRING) END, 'class', concat('K', o_orderkey % 5)) AS custom",
        "CASE o_orderkey % 8 WHEN 0 THEN array(named_struct('id', 'OMIM:1', 'name', 'Marfan syndrome'), named_struct('id', 'HP:0001', 'name', 'short stature')) WHEN 1 THEN array(named_struct('id', 'HP:0001', 'name', 'short stature')) ELSE CAST(array() AS array<struct<id: string, name: string>>) END AS gene_traits",
        "CASE o_orderkey % 9 WHEN 0 THEN array('aspirin') WHEN 4 THEN array('aspirin', 'tamoxifen') ELSE CAST(array() AS array<string>) END AS drugs",
        "CASE o_orderkey % 10 WHEN 0 THEN array('Kinase') WHEN 3 THEN array('Membrane', 'Kinase') ELSE CAST(array() AS array<string>) END AS keywords",
    )
    return rows.withColumn("end", F.col("start") + F.col("key") % 50)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a variant and sample: the best of its line items, by a total order."""
    order = [F.expr("l_discount <= 0.05").desc(), F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_quantity")]
    # Dealt out by variant at once: the window, and what groups or joins by variant afterwards, need no further shuffle.
    rows = read(spark, sf_dir, "lineitem").repartition("l_orderkey").withColumn("sample", F.col("l_suppkey") % 20)
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy("l_orderkey", "sample").orderBy(*order))).filter("rn = 1")
    return rows.selectExpr(
        "l_orderkey AS key",
        "sample",
        f"{GENOTYPE} AS gt",
        "CAST(l_quantity AS INT) AS dp",
        "CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_quantity * 2 AS INT) END AS gq",
        "l_extendedprice / 1000 AS qual",
        "CASE WHEN l_discount <= 0.05 THEN array('PASS') WHEN l_tax > 0.04 THEN array('LowGQX', 'LowQ') ELSE array('LowGQX') END AS filter",
        "concat('file', sample % 5) AS file",
        "l_orderkey * 31 % 17 = sample % 17 AS phased",
        "concat('NA', 12800 + sample) AS name",
    )


def consequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a variant and transcript."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS key",
        "concat('G', l_partkey % 300) AS gene",
        "concat('T', l_partkey, '.', l_linenumber) AS transcript",
        f"{BIOTYPE} AS biotype",
        f"{TERM} AS term",
        "CASE WHEN l_suppkey % 2 = 0 THEN 'canonical' ELSE 'basic' END AS flag",
        "CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_partkey * 7 % 100 AS DOUBLE) / 100 END AS sift",
        "CASE WHEN l_partkey % 9 <> 0 THEN CASE WHEN l_partkey * 7 % 100 < 5 THEN 'deleterious' ELSE 'tolerated' END END AS sift_text",
        "CASE WHEN l_partkey % 8 <> 0 THEN CAST(l_partkey * 3 % 100 AS DOUBLE) / 100 END AS polyphen",
        "CASE WHEN l_partkey % 8 <> 0 THEN CASE WHEN l_partkey * 3 % 100 < 45 THEN 'benign' WHEN l_partkey * 3 % 100 < 91 THEN 'possibly damaging' ELSE 'probably damaging' END END AS polyphen_text",
    )


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a variant and piece of clinical evidence."""
    return read(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0 OR o_orderkey % 10 = 0").selectExpr(
        "o_orderkey AS key",
        "inline(filter(array(CASE WHEN o_orderkey % 4 = 0 THEN named_struct('source', 'clinvar', 'significance', CASE o_orderkey % 3 WHEN 0 THEN 'pathogenic' WHEN 1 THEN 'benign' ELSE 'likely_pathogenic' END, 'status', CASE WHEN o_orderkey % 8 = 0 THEN 'confirmed' ELSE 'not_confirmed' END) END,"
        " CASE WHEN o_orderkey % 10 = 0 THEN named_struct('source', 'cosmic', 'significance', 'pathogenic', 'status', 'not_confirmed') END), x -> x IS NOT NULL))",
    )


def members(spark: SparkSession) -> DataFrame:
    """Samples 0 to 19 and their cohorts."""
    return spark.range(20).selectExpr("id AS sample", "concat('C', id % 4) AS cohort")


def trios(spark: SparkSession) -> DataFrame:
    """Families of three samples: child, father, mother."""
    return spark.range(6).selectExpr("concat('trio', id) AS trio", "id * 3 AS child", "id * 3 + 1 AS father", "id * 3 + 2 AS mother")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth by position: minutes of events as positions, events a minute and their values as depth."""
    rows = read(spark, sf_dir, "events").selectExpr("concat('chr', user_id % 3) AS chrom", "CAST(floor(unix_timestamp(ts) / 60) % 5000 AS BIGINT) AS pos", "CAST(value AS INT) AS v")
    return rows.groupBy("chrom", "pos").agg(F.sum("v").cast("long").alias("depth"))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a variant and cohort that has calls: frequencies, and members without a call as missing."""
    out = cohorts.cohort_stats(calls(spark, sf_dir), members(spark))
    missing = F.col("n_samples") - F.col("n_calls")
    return out.select("key", "cohort", "ref_freq", "alt_freq", "maf", "mgf", "pass_freq", (2 * missing).alias("missing_alleles"), missing.alias("missing_genotypes"))


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene sets by kind and term: ontology terms, expression, roles in cancer, panels."""
    rows = read(spark, sf_dir, "part").selectExpr("concat('G', p_partkey % 300) AS gene", "p_partkey % 300 AS g").distinct()
    term = {"go": "concat('GO:', g % 7)", "expression": "concat('tissue', g % 5)", "geneRoleInCancer": "CASE WHEN g % 11 = 0 THEN 'TSG' WHEN g % 11 = 1 THEN 'oncogene' END", "panel": "concat('panel', g % 13)"}
    return rows.select("gene", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(e).alias("term")) for k, e in term.items())))).filter("term IS NOT NULL")


#: The parents of samples, and their families: what trios() has, for filters by mode of inheritance.
PEDIGREES = {str(3 * k): {"father": 3 * k + 1, "mother": 3 * k + 2, "family": f"trio{k}"} for k in range(6)}


def tables(spark: SparkSession, sf_dir: str) -> dict:
    """The tables by variant key that filters look into."""
    return {name: functools.partial(make, spark, sf_dir) for name, make in (("cts", consequences), ("evidence", clinical), ("calls", calls), ("stats", stats))}


PARTS = ("cts", "evidence", "calls")


def wide(spark: SparkSession, sf_dir: str, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Variants with nested consequences, evidence and calls: the row that filters are compiled for.

    Parts that are not asked for are neither read nor joined.
    """
    fold = lambda df: df.groupBy("key").agg(F.collect_list(F.struct(*(c for c in df.columns if c != "key"))).alias("rows"))
    rows = variants(spark, sf_dir)
    for name, make in tables(spark, sf_dir).items():
        if name in parts:
            rows = rows.join(fold(make()).withColumnRenamed("rows", name), "key", "left").withColumn(name, F.coalesce(name, F.array()))
    return rows


#: The same tables in DuckDB's SQL, for the queries' counterparts.
SQL = f"""
WITH variants AS (
  SELECT *, start + key % 50 AS "end" FROM (SELECT o_orderkey AS key, CAST(o_custkey % 22 + 1 AS VARCHAR) AS chrom, (o_orderkey * 7919) % 1000000 + 1 AS start,
    substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1) AS reference, substr('ACGT', CAST((o_orderkey + 1 + o_orderkey % 3) % 4 + 1 AS INT), 1) AS alternate,
    {TYPE} AS type, o_orderkey % 4 + 1 AS release, 'S' || o_orderstatus AS study,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey * 37 % 400 AS DOUBLE) / 10 END AS cadd,
    CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey * 13 % 1000 AS DOUBLE) / 1000 END AS freq,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey * 29 % 1000 AS DOUBLE) / 1000 END AS phastcons,
    CASE o_orderkey % 6 WHEN 0 THEN 'asthma' WHEN 1 THEN 'breast cancer' WHEN 2 THEN 'ovarian cancer' END AS trait,
    CASE WHEN o_orderkey % 4 = 0 THEN 'rs' || o_orderkey END AS rs, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey * 17 % 1000 AS DOUBLE) / 1000 END AS freq2,
    CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey * 41 % 100 AS DOUBLE) / 10 END AS cadd_raw, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey * 23 % 1000 AS DOUBLE) / 1000 END AS phylop,
    CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey * 19 % 120 AS DOUBLE) / 10 END AS gerp, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey * 11 % 1000 AS DOUBLE) / 1000 END AS gwas1 FROM orders)),
calls AS (
  SELECT l_orderkey AS key, sample, {GENOTYPE} AS gt, CAST(l_quantity AS INT) AS dp, CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_quantity * 2 AS INT) END AS gq, l_extendedprice / 1000 AS qual,
    CASE WHEN l_discount <= 0.05 THEN ['PASS'] WHEN l_tax > 0.04 THEN ['LowGQX', 'LowQ'] ELSE ['LowGQX'] END AS filter, 'file' || (sample % 5) AS file, l_orderkey * 31 % 17 = sample % 17 AS phased, 'NA' || (12800 + sample) AS name
  FROM (SELECT *, l_suppkey % 20 AS sample, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 20 ORDER BY CASE WHEN l_discount <= 0.05 THEN 0 ELSE 1 END, l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1),
cts AS (
  SELECT l_orderkey AS key, 'G' || (l_partkey % 300) AS gene, 'T' || l_partkey || '.' || l_linenumber AS transcript, {BIOTYPE} AS biotype, {TERM} AS term,
    CASE WHEN l_suppkey % 2 = 0 THEN 'canonical' ELSE 'basic' END AS flag, CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_partkey * 7 % 100 AS DOUBLE) / 100 END AS sift,
    CASE WHEN l_partkey % 8 <> 0 THEN CAST(l_partkey * 3 % 100 AS DOUBLE) / 100 END AS polyphen FROM lineitem),
evidence AS (
  SELECT o_orderkey AS key, 'clinvar' AS source, CASE o_orderkey % 3 WHEN 0 THEN 'pathogenic' WHEN 1 THEN 'benign' ELSE 'likely_pathogenic' END AS significance, CASE WHEN o_orderkey % 8 = 0 THEN 'confirmed' ELSE 'not_confirmed' END AS status FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT o_orderkey, 'cosmic', 'pathogenic', 'not_confirmed' FROM orders WHERE o_orderkey % 10 = 0),
members AS (SELECT range AS sample, 'C' || (range % 4) AS cohort FROM range(20)),
trios AS (SELECT 'trio' || range AS trio, range * 3 AS child, range * 3 + 1 AS father, range * 3 + 2 AS mother FROM range(6)),
coverage AS (SELECT 'chr' || (user_id % 3) AS chrom, CAST(floor(epoch(ts) / 60) AS BIGINT) % 5000 AS pos, CAST(sum(CAST(trunc(value) AS INT)) AS BIGINT) AS depth FROM events GROUP BY 1, 2)
"""
