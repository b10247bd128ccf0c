"""Inheritance: trios, Mendelian errors, compound heterozygotes, modes of inheritance, knockouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import inheritance as I
from ..functions import variant as V


def trio_genotypes(calls: DataFrame, trios: DataFrame, missing: str = "0/0") -> DataFrame:
    """One row a variant and trio in which someone is called: trio, child, father, mother genotypes; the rest are missing ones."""
    roles = trios.select("trio", F.explode(F.map_from_arrays(F.array(*map(F.lit, ("child", "father", "mother"))), F.array("child", "father", "mother"))).alias("role", "sample"))
    named = calls.select("key", "sample", "gt").join(F.broadcast(roles), "sample")  # three rows a trio
    pick = lambda r: F.coalesce(F.max(F.when(F.col("role") == r, F.col("gt"))), F.lit(missing)).alias(r)
    return named.groupBy("key", "trio").agg(pick("child"), pick("father"), pick("mother"))


def mendelian_errors(trios: DataFrame, chrom: Column | None = None) -> DataFrame:
    """Trios with an error, its code, whether it is de novo, and strictly so (both parents without the allele)."""
    rows = trios.withColumn("code", I.mendelian_error(F.col("child"), F.col("father"), F.col("mother"), chrom)).filter("code > 0")
    return rows.withColumn("de_novo", F.col("code").isin(*I.DE_NOVO)).withColumn("strict", F.col("code").isin(*I.DE_NOVO_STRICT))


def by_modes(trios: DataFrame, modes: tuple[str, ...], chrom: str = "chrom") -> DataFrame:
    """One row a trio and mode that it fits, in one pass over the trios."""
    people = F.col(chrom), F.col("child"), F.col("father"), F.col("mother")
    fitting = F.array_compact(F.array(*(F.when(I.fits(m, *people), F.lit(m)) for m in modes)))
    return trios.withColumn("mode", F.explode(fitting))


def compound_heterozygotes(trios: DataFrame, transcripts: DataFrame, by: str = "gene") -> DataFrame:
    """By trio and gene: heterozygous variants of the child from the father alone and from the mother alone, where both occur."""
    het = trios.filter((V.genotype_class(F.col("child")) == "HET_REF") & (V.carries(F.col("father")) != V.carries(F.col("mother"))))
    origin = het.select("trio", "key", F.when(V.carries(F.col("father")), "father").otherwise("mother").alias("origin"))
    rows = origin.join(transcripts.select("key", by).distinct(), "key")
    out = rows.groupBy("trio", by).agg(F.count(F.when(F.col("origin") == "father", 1)).alias("n_father"), F.count(F.when(F.col("origin") == "mother", 1)).alias("n_mother"))
    return out.filter("n_father > 0 AND n_mother > 0").withColumn("n_pairs", F.col("n_father") * F.col("n_mother"))


def compound_heterozygous_variants(trios: DataFrame, transcripts: DataFrame, by: str = "transcript") -> DataFrame:
    """Variants of a child that pair with one of the other parent in the same transcript or gene: key, trio, that, and the origin.

    One row a variant, not a pair: every father's variant of a group pairs with every mother's.
    """
    het = trios.filter((V.genotype_class(F.col("child")) == "HET_REF") & (V.carries(F.col("father")) != V.carries(F.col("mother"))))
    rows = het.select("trio", "key", F.when(V.carries(F.col("father")), "father").otherwise("mother").alias("origin")).join(transcripts.select("key", by).distinct(), "key")
    both = rows.groupBy("trio", by).agg(F.countDistinct("origin").alias("origins")).filter("origins = 2").select("trio", by)
    return rows.join(both, ["trio", by]).select("key", "trio", by, "origin")


def knockouts(calls: DataFrame, consequences: DataFrame, terms: tuple[str, ...], trios: DataFrame) -> DataFrame:
    """By sample and gene: kinds of knockout by variants of the given terms: HOM_ALT, HET_ALT, and COMP_HET, pairs of heterozygous ones.

    A pair counts if one of it comes from the father alone and one from the mother alone, so samples without parents have none.
    """
    hit = consequences.filter(F.col("term").isin(*terms)).select("key", "gene").distinct()
    rows = calls.join(hit, "key").withColumn("c", V.genotype_class(F.col("gt")))
    n = lambda k: F.count(F.when(F.col("c") == k, 1))
    counts = rows.groupBy("sample", "gene").agg(n("HOM_ALT").alias("hom_alt"), n("HET_ALT").alias("het_alt"))
    pairs = compound_heterozygotes(trio_genotypes(calls, trios), hit).join(F.broadcast(trios.select("trio", F.col("child").alias("sample"))), "trio").select("sample", "gene", F.col("n_pairs").alias("comp_het"))
    return counts.join(pairs, ["sample", "gene"], "left").withColumn("comp_het", F.coalesce("comp_het", F.lit(0).cast("long"))).filter("hom_alt + het_alt + comp_het > 0")


def inferred_sex(ratios: DataFrame) -> DataFrame:
    """Karyotype from the coverage of X and Y by that of autosomes."""
    x, y = F.col("x_ratio"), F.col("y_ratio")
    return ratios.withColumn("sex", F.when((x > 0.75) & (y < 0.1), "XX").when((x <= 0.75) & (y >= 0.25), "XY").when((x > 0.75) & (y >= 0.25), "XXY").when((x <= 0.75) & (y < 0.1), "X0").otherwise("UNKNOWN"))
