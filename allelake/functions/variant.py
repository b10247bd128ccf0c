"""Column functions over alleles, loci and genotypes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which types a type takes in.
SUBTYPES = {"SNV": ("SNV", "SNP"), "INDEL": ("INDEL", "INSERTION", "DELETION"), "MNV": ("MNV", "MNP"), "CNV": ("CNV", "COPY_NUMBER_GAIN", "COPY_NUMBER_LOSS"), "SV": ("SV", "BREAKEND", "INVERSION", "TRANSLOCATION", "DUPLICATION")}
#: Consequence terms of loss of function, and those that alter a protein besides.
LOF = ("frameshift_variant", "incomplete_terminal_codon_variant", "start_lost", "stop_gained", "stop_lost", "splice_acceptor_variant", "splice_donor_variant", "transcript_ablation", "feature_truncation")
PROTEIN_ALTERING = (*LOF, "inframe_deletion", "inframe_insertion", "missense_variant")
#: Accessions of the consequence terms.
ACCESSIONS = {
    "transcript_ablation": "SO:0001893",
    "splice_acceptor_variant": "SO:0001574",
    "splice_donor_variant": "SO:0001575",
    "stop_gained": "SO:0001587",
    "frameshift_variant": "SO:0001589",
    "stop_lost": "SO:0001578",
    "start_lost": "SO:0002012",
    "initiator_codon_variant": "SO:0001582",
    "transcript_amplification": "SO:0001889",
    "feature_elongation": "SO:0001907",
    "feature_truncation": "SO:0001906",
    "inframe_insertion": "SO:0001821",
    "inframe_deletion": "SO:0001822",
    "inframe_variant": "SO:0001650",
    "missense_variant": "SO:0001583",
    "protein_altering_variant": "SO:0001818",
    "splice_region_variant": "SO:0001630",
    "incomplete_terminal_codon_variant": "SO:0001626",
    "terminator_codon_variant": "SO:0001590",
    "start_retained_variant": "SO:0002019",
    "stop_retained_variant": "SO:0001567",
    "synonymous_variant": "SO:0001819",
    "coding_sequence_variant": "SO:0001580",
    "mature_miRNA_variant": "SO:0001620",
    "5_prime_UTR_variant": "SO:0001623",
    "3_prime_UTR_variant": "SO:0001624",
    "exon_variant": "SO:0001791",
    "non_coding_transcript_exon_variant": "SO:0001792",
    "intron_variant": "SO:0001627",
    "NMD_transcript_variant": "SO:0001621",
    "non_coding_transcript_variant": "SO:0001619",
    "upstream_gene_variant": "SO:0001631",
    "downstream_gene_variant": "SO:0001632",
    "TFBS_ablation": "SO:0001895",
    "TFBS_amplification": "SO:0001892",
    "TF_binding_site_variant": "SO:0001782",
    "regulatory_region_ablation": "SO:0001894",
    "regulatory_region_amplification": "SO:0001891",
    "regulatory_region_variant": "SO:0001566",
    "intergenic_variant": "SO:0001628",
}
#: Names of genotype classes.
CLASSES = ("HOM_REF", "HOM_ALT", "HET", "HET_REF", "HET_ALT", "HET_MISS", "MISS", "SEC", "SEC_ALT", "MAIN_ALT", "NA")
SEPARATOR, PIECES = re.compile(r"[/|]"), re.compile(r"\d+|[/|.]")


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def chrom_order(chrom: Column | str) -> Column:
    """A string to sort chromosomes by: one-digit names get a zero, also before an underscore."""
    c = F.col(chrom) if isinstance(chrom, str) else chrom
    return F.when(c.rlike("^[0-9](_|$)"), F.concat(F.lit("0"), c)).otherwise(c)


def variant_id(chrom="chrom", start="start", reference="reference", alternate="alternate") -> Column:
    return F.concat_ws(":", F.col(chrom), F.col(start).cast("string"), F.col(reference), F.col(alternate))


def clean_chromosome(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "(?i)^(chrom|chrm|chr|ch)(?=.)", "")


def alleles(gt: Column) -> Column:
    return F.split(gt, r"[/|]")


def unphased(gt: Column) -> Column:
    """The genotype with '/' between its alleles in ascending order."""
    return F.array_join(F.array_sort(alleles(gt)), "/")


def genotype_class(gt: Column) -> Column:
    """HOM_REF, HOM_ALT, HET_REF, HET_ALT, MISS, HET_MISS or NA, by distinct alleles."""
    a = alleles(gt)
    distinct = F.array_distinct(a)
    missing = F.array_contains(a, ".")
    return (
        F.when(gt.isNull() | (gt == "NA"), "NA")
        .when(missing & (F.size(distinct) == 1), "MISS")
        .when(missing, "HET_MISS")
        .when(F.size(distinct) == 1, F.when(a[0] == "0", "HOM_REF").otherwise("HOM_ALT"))
        .when(F.array_contains(a, "0"), "HET_REF")
        .otherwise("HET_ALT")
    )


def is_class(gt: Column, name: str) -> Column:
    """Whether a genotype is of a class; HET, SEC, SEC_ALT and MAIN_ALT take in several."""
    if name == "MAIN_ALT":
        return carries(gt)
    if name in ("SEC", "SEC_ALT"):  # an alternate beyond the first; SEC_ALT: no reference allele beside it
        second = F.exists(alleles(gt), lambda a: a.rlike(r"^\d+$") & ~a.isin("0", "1"))
        return second & ~F.array_contains(alleles(gt), "1") & (~F.array_contains(alleles(gt), "0") if name == "SEC_ALT" else F.lit(True))
    return genotype_class(gt).isin(*{"HET": ("HET_REF", "HET_ALT", "HET_MISS")}.get(name, (name,)))


def carries(gt: Column, allele: str = "1") -> Column:
    """Whether the main alternate is among the alleles."""
    return F.coalesce(F.array_contains(alleles(gt), allele), F.lit(False))


def is_transition(reference: Column, alternate: Column) -> Column:
    return F.concat(reference, alternate).isin("AG", "GA", "CT", "TC")


def is_transversion(reference: Column, alternate: Column) -> Column:
    return reference.isin(*"ACGT") & alternate.isin(*"ACGT") & (reference != alternate) & ~is_transition(reference, alternate)


def inferred_type(reference: Column, alternate: Column) -> Column:
    r, a = F.length(reference), F.length(alternate)
    return (
        F.when(alternate.rlike(r"^<.*>$"), F.regexp_extract(alternate, r"^<([^:>]*)", 1))
        .when(alternate.rlike(r"[\[\]]"), "BREAKEND")
        .when((r == 1) & (a == 1), "SNV")
        .when(r == a, "MNV")
        .when((r == 0) | ((a > r) & F.startswith(alternate, reference)), "INSERTION")
        .when((a == 0) | ((r > a) & F.startswith(reference, alternate)), "DELETION")
        .otherwise("INDEL")
    )


def reverse_complement(sequence: Column) -> Column:
    return F.translate(F.reverse(sequence), "ACGT", "TGCA")


def substitution_key(before: Column, reference: Column, after: Column, alternate: Column) -> Column:
    """The class of a substitution in its context, on the strand where the reference is C or T: A[C>T]G."""
    turn = reference.isin("A", "G")
    flip = lambda c: F.when(turn, F.translate(c, "ACGT", "TGCA")).otherwise(c)
    left, right = F.when(turn, F.translate(after, "ACGT", "TGCA")).otherwise(before), F.when(turn, F.translate(before, "ACGT", "TGCA")).otherwise(after)
    return F.concat(left, F.lit("["), flip(reference), F.lit(">"), flip(alternate), F.lit("]"), right)


def size_class(length: Column) -> Column:
    """The size class of a structural variant."""
    return F.when(length < 1000, "<1Kb").when(length < 10_000, "1-10Kb").when(length < 100_000, "10-100Kb").when(length < 1_000_000, "100Kb-1Mb").when(length < 10_000_000, "1Mb-10Mb").otherwise(">10Mb")


def minor(freq: Column) -> Column:
    """The frequency of the rarer allele."""
    return F.least(freq, 1 - freq)


def trimmed(start: Column, reference: Column, alternate: Column) -> Column:
    """A struct of start, reference, alternate without the bases that both alleles share: first at the end, then at the front."""
    same_end = F.expr("0")
    def shared(a: Column, b: Column) -> Column:
        most = F.least(F.length(a), F.length(b))
        return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), most), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))), same_end)
    tail = shared(F.reverse(reference), F.reverse(alternate))
    r, a = F.substring(reference, F.lit(1), F.length(reference) - tail), F.substring(alternate, F.lit(1), F.length(alternate) - tail)
    head = shared(r, a)
    return F.struct((start + head).alias("start"), F.substring(r, head + 1, F.length(r)).alias("reference"), F.substring(a, head + 1, F.length(a)).alias("alternate"))


def compare(value: Column, op: str, bound) -> Column:
    """The search index's comparisons: '!=' and the doubled operators hold for missing values, all others do not."""
    b = F.lit(bound)
    plain = {"=": value == b, "==": value == b, "!=": value != b, "<": value < b, "<=": value <= b, ">": value > b, ">=": value >= b, "<<": value < b, "<<=": value <= b, ">>": value > b, ">>=": value >= b}[op]
    return F.coalesce(plain, F.lit(op == "!=" or op[:2] in ("<<", ">>")))


def is_number(text: str) -> bool:
    try:
        float(text)
    except ValueError:
        return False
    return True


def row_compare(value: Column, op: str, bound: str) -> Column:
    """Comparisons over the fields of calls and files: false for missing values; numbers where the bound is one, else text."""
    if is_number(bound):
        b, v = F.lit(float(bound)), value.try_cast("double")
    else:
        b, v = F.lit(bound), value.cast("string")
    plain = {"=": v == b, "==": v == b, "!=": v != b, "<": v < b, "<=": v <= b, ">": v > b, ">=": v >= b, "<<": v < b, "<<=": v <= b, ">>": v > b, ">>=": v >= b, "~": v.cast("string").rlike(bound), "=~": v.cast("string").rlike(bound), "!~": ~v.cast("string").rlike(bound)}[op]
    return F.coalesce(plain, F.lit(False))


#: Codes of genotypes; those from 9 on do not tell the genotype.
GENOTYPE_CODES = {"0/0": 0, "0/1": 1, "1/1": 2, "0|0": 3, "0|1": 4, "1|0": 5, "1|1": 6, "0": 7, "1": 8}
MULTI_HOM, MULTI_HET, MISSING_HOM, MISSING_HET, UNKNOWN, DISCREPANCY_SIMPLE, DISCREPANCY_ANY = range(9, 16)


def genotype_code(gt: Column) -> Column:
    """The code of a genotype, of four bits."""
    out = F.when(gt.isNull() | gt.isin("", "?/?"), UNKNOWN)
    for name, code in GENOTYPE_CODES.items():
        out = out.when(gt == name, code)
    a = alleles(gt)
    same = F.size(F.array_distinct(a)) == 1
    return out.when(F.array_contains(a, "."), F.when(same, MISSING_HOM).otherwise(MISSING_HET)).when(gt == "1/0", 1).otherwise(F.when(same, MULTI_HOM).otherwise(MULTI_HET))


def genotypes_code(gts: Column) -> Column:
    """The code of the genotypes that several files give one sample: that of the only one, or what kind of discrepancy they are."""
    codes = F.transform(F.array_distinct(gts), genotype_code)
    plain = F.forall(codes, lambda c: (c < MULTI_HOM) & ~c.isin(0, 3))
    return F.when(F.size(codes) == 1, F.get(codes, 0)).otherwise(F.when(plain, DISCREPANCY_SIMPLE).otherwise(DISCREPANCY_ANY))


def parents_code(father: Column, mother: Column) -> Column:
    """Both parents' codes as one byte."""
    return F.shiftleft(father.cast("int"), 4).bitwiseOR(mother.cast("int"))


def clinical_tokens(evidence: Column) -> Column:
    """What evidence is looked up by: its source, its significance, and these joined, with the status behind them if confirmed."""

    def of(e: Column) -> Column:
        both = F.concat_ws("_", e["source"], e["significance"])
        status = F.when(e["status"] == "confirmed", F.lit("confirmed"))
        return F.array_compact(F.array(e["source"], e["significance"], F.when(e["significance"].isNotNull(), both), F.when(e["significance"].isNotNull(), F.concat(both, F.lit("_"), status)), F.concat(e["significance"], F.lit("_"), status), F.concat(e["source"], F.lit("_"), status)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(evidence, of))))


def left_aligned(start: Column, context: Column, sequence: Column) -> Column:
    """A struct of start and sequence of an insertion or deletion moved left as far as the bases before it allow.

    context: the bases before start, sequence: the inserted or deleted bases. It moves by one while the base before it
    equals its last one; the bases rotate with it.
    """
    n, m = F.length(sequence), F.length(context)
    base = lambda k: F.substring(context, m - k, F.lit(1))  # noqa: E731  k bases before the last one
    turned = lambda k: F.substring(sequence, n - k % n, F.lit(1))
    stop = F.array_min(F.filter(F.sequence(F.lit(0), m), lambda k: (k == m) | (base(k) != turned(k))))
    moved = F.coalesce(stop, F.lit(0))
    turn = moved % n
    return F.struct((start - moved).alias("start"), F.concat(F.substring(sequence, n - turn + 1, turn), F.substring(sequence, F.lit(1), n - turn)).alias("sequence"))
