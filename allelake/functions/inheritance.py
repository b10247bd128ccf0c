"""Mendelian rules as columns over the genotypes of a child and its parents."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import variant as V

#: Codes of Mendelian errors whose child carries an allele that is new, and those with both parents without it.
DE_NOVO, DE_NOVO_STRICT = (2, 3, 4, 5, 10, 12), (2, 5)
AUTOSOMES, X, Y, MT = "autosomes", ("X",), ("Y",), ("MT", "M")


def on_chromosomes(chrom: Column, names) -> Column:
    if names is None:
        return F.lit(True)
    return ~chrom.isin(*X, *Y, *MT) if names == AUTOSOMES else chrom.isin(*names)


class Rule(NamedTuple):
    """Where a rule holds, and the genotype classes that child, father and mother may have (None: any)."""

    chromosomes: object
    classes: tuple


_REF, _HET, _ALT, _ANY_HET = {"HOM_REF"}, {"HET_REF"}, {"HOM_ALT"}, {"HET_REF", "HET_ALT"}
_CARRIER = _HET | _ALT
#: Modes of inheritance as alternatives of rules. The child is affected; parents are not, save by a dominant allele.
MODES = {
    "autosomalRecessive": [Rule(AUTOSOMES, (_ALT, _HET, _HET))],
    "autosomalDominant": [Rule(AUTOSOMES, (_CARRIER, _REF, _CARRIER))],
    "xLinkedRecessive": [Rule(X, (_ALT, _REF, _HET))],
    "xLinkedDominant": [Rule(X, (_CARRIER, _REF, _CARRIER)), Rule(X, (_HET, _ALT, _REF))],
    "yLinked": [Rule(Y, (_ALT, _ALT, None))],
    "mitochondrial": [Rule(MT, (_CARRIER, None, _CARRIER))],
    "deNovo": [Rule(None, (_ANY_HET, _REF, _REF)), Rule(AUTOSOMES, (_ALT, _REF, None)), Rule(AUTOSOMES, (_ALT, None, _REF)), Rule(X + MT, (_ALT, None, _REF)), Rule(Y, (_ALT, _REF, None))],
    "deNovoStrict": [Rule(AUTOSOMES, (_ANY_HET | _ALT, _REF, _REF))],
    "mendelianError": [
        Rule(AUTOSOMES, (_ANY_HET, _REF, _REF)), Rule(AUTOSOMES, (_HET, _ALT, _ALT)),
        Rule(AUTOSOMES, (_ALT, _REF, None)), Rule(AUTOSOMES, (_ALT, None, _REF)), Rule(AUTOSOMES, (_REF, _ALT, None)), Rule(AUTOSOMES, (_REF, None, _ALT)),
        Rule(X + MT, (_REF, None, _ALT)), Rule(X + MT, (_ALT, None, _REF)), Rule(Y, (_REF, _ALT, None)), Rule(Y, (_ALT, _REF, None)),
    ],
}


def mode_name(name: str) -> str:
    """A mode by its name or its constant: X_LINKED_RECESSIVE is xLinkedRecessive."""
    if name in MODES:
        return name
    head, *rest = name.lower().split("_")
    return head + "".join(w.capitalize() for w in rest)


def fits(mode: str, chrom: Column, child: Column, father: Column, mother: Column) -> Column:
    """Whether the three genotypes fit a mode of inheritance."""
    people = [V.genotype_class(c) for c in (child, father, mother)]
    return V.any_of([on_chromosomes(chrom, r.chromosomes) & V.all_of([p.isin(*sorted(a)) for p, a in zip(people, r.classes) if a is not None]) for r in MODES[mode]])


def mendelian_error(child: Column, father: Column, mother: Column, chrom: Column | None = None) -> Column:
    """The code of a Mendelian error, 0 where there is none, null where a genotype is missing. A parent that is null is not known.

    code  father  mother  child
      1    1/1     1/1     0/1
      2    0/0     0/0     0/1
      3    0/0    !0/0     1/1
      4   !0/0     0/0     1/1
      5    0/0     0/0     1/1
      6    1/1    !1/1     0/0
      7   !1/1     1/1     0/0
      8    1/1     1/1     0/0
      9            1/1     0/0    X of a haploid child, MT
     10            0/0     1/1    X of a haploid child, MT
     11    1/1             0/0    Y
     12    0/0             1/1    Y

    With several alternates, a homozygous child's allele counts as 1, and what a parent lacks of it as its absence; a
    heterozygous child has code 2 if a parent's allele explains one of its alternates in neither, else 1.
    """
    chrom = F.lit("1") if chrom is None else chrom
    c = V.alleles(child)
    x, y = F.get(c, 0), F.coalesce(F.get(c, 1), F.get(c, 0))
    lacks = lambda parent, allele: F.coalesce(~F.array_contains(V.alleles(parent), allele), F.lit(False))
    gives = lambda parent, allele: ~lacks(parent, allele)
    no_father, no_mother = lacks(father, x), lacks(mother, x)
    is_ref = x == "0"
    same = F.when(no_father & no_mother, F.when(is_ref, 8).otherwise(5)).when(no_father, F.when(is_ref, 6).otherwise(3)).when(no_mother, F.when(is_ref, 7).otherwise(4)).otherwise(0)
    ok = (gives(father, x) & gives(mother, y)) | (gives(father, y) & gives(mother, x))
    new = V.any_of([(a != "0") & lacks(father, a) & lacks(mother, a) for a in (x, y)])
    other = F.when(ok, 0).when(new, 2).otherwise(1)
    by_mother = F.when(no_mother, F.when(is_ref, 9).otherwise(10)).otherwise(0)
    by_father = F.when(no_father, F.when(is_ref, 11).otherwise(12)).otherwise(0)
    lone = (x == y) & (chrom.isin(*MT) | (chrom.isin(*X) & (F.size(c) == 1)))
    code = F.when(lone, by_mother).when((x == y) & chrom.isin(*Y), by_father).when(x == y, same).otherwise(other)
    missing = V.any_of([child.isNull(), F.array_contains(c, "."), *(F.coalesce(F.array_contains(V.alleles(p), "."), F.lit(False)) for p in (father, mother))])
    return F.when(~missing, code)
