"""Filter parameters compiled to one boolean column.

All parameters hold together; within one, ',' and ';' say any or all. Conditions on consequences (cts), clinical evidence,
calls and cohort statistics (stats) hold on one row of these. A compiler is told how to ask for such a row: query() looks
into nested arrays of the variant's row, select() into the tables themselves, of which only the rows that a condition
names are read, grouped by variant and joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import inheritance as I
from ..functions import variant as V
from . import language as L

#: Regions beyond this number are joined rather than spelled out as alternatives.
MANY_REGIONS = 20
#: The transcript flags that queries may name.
FLAGS = ("canonical", "MANE Select", "MANE Plus Clinical", "CCDS", "basic", "LRG", "EGLH_HaemOnc", "TSO500")
#: The sources that scores may be named by.
CONSERVATION, FUNCTIONAL, SUBSTITUTION = ("phastCons", "phylop", "gerp"), ("cadd_scaled", "cadd_raw"), ("sift", "polyphen")
#: Where a query may be answered from.
SOURCES = ("variant_index", "secondary_sample_index")
#: Gene sets that a knowledge table resolves.
GENE_SETS = ("go", "expression", "geneRoleInCancer", "panel")
#: Parameters of older queries and those that took their place.
LEGACY = {"sift": "proteinSubstitution", "polyphen": "proteinSubstitution", "clinvar": "xref", "cosmic": "xref"}
#: Comparisons that hold for missing values.
WITH_MISSING = ("!=", "<<", "<<=", ">>", ">>=")

#: Which tables a parameter looks into.
LOOKS_INTO = {
    "cts": {"gene", "biotype", "ct", "transcriptFlag", "annotationExists", "xref", "proteinSubstitution", "sift", "polyphen", "clinvar", "cosmic"},
    "evidence": {"clinical", "clinicalSignificance", "clinicalConfirmedStatus", "xref", "clinvar", "cosmic"},
    "calls": {"genotype", "sample", "sampleData", "file", "fileData", "filter", "qual", "family", "familySegregation"},
    "stats": {"cohort", "cohortStatsRef", "cohortStatsAlt", "cohortStatsMaf", "cohortStatsMgf", "cohortStatsPass", "missingAlleles", "missingGenotypes"},
}


def parts(params: dict) -> tuple[str, ...]:
    """The nested arrays that a query needs; a caller can leave the others out of its rows."""
    return tuple(p for p, names in LOOKS_INTO.items() if names & set(params))


def _joined(columns: list[Column], by: str | None) -> Column:
    return V.all_of(columns) if by == L.AND else V.any_of(columns)


def _listed(text: str, test) -> Column:
    """A list whose values may be negated one by one."""
    found = L.terms(text)
    out = []
    for v in found.values:
        no, value = L.negated(v)
        out.append(~test(value) if no else test(value))
    return _joined(out, found.joined_by)


def _number(c: L.Comparison) -> float:
    try:
        return float(c.value)
    except ValueError:
        raise L.LanguageError(f"no number: {c.value!r}") from None


def _known(key: str, names: tuple[str, ...]) -> str:
    if key not in names:
        raise L.LanguageError(f"{key!r} is none of {', '.join(names)}")
    return key


def _numbers(text: str, field: Callable[[str], Column]) -> Column:
    found, by = L.comparisons(text)
    return _joined([V.compare(field(c.key), c.op, _number(c)) for c in found], by)


def region_condition(regions: list[L.Region], contained: bool = False) -> Column:
    """Overlap with any of the regions; contained: the start alone must lie in one."""
    out = []
    for r in L.merged(regions):
        c = F.col("chrom") == r.chrom
        if r.start is not None:
            c = c & (F.col("start") >= r.start if contained else F.col("end") >= r.start)
        if r.end is not None:
            c = c & (F.col("start") <= r.end)
        out.append(c)
    return V.any_of(out)


def id_condition(text: str) -> Column:
    loci, names = [], []
    for v in L.terms(text).values:
        parts = v.split(":")
        if len(parts) == 4:
            loci.append((F.col("chrom") == L.chromosome(parts[0])) & (F.col("start") == int(parts[1])) & (F.col("reference") == parts[2]) & (F.col("alternate") == parts[3]))
        else:
            names.append(v)
    return V.any_of([*loci, *([F.coalesce(F.col("rs").isin(*names), F.lit(False))] if names else [])])


def type_condition(text: str) -> Column:
    values = L.terms(text).values
    no = L.same_sign(values)
    wanted = sorted({t for v in values for t in V.SUBTYPES.get(v.lstrip("!").upper(), (v.lstrip("!").upper(),))})
    c = F.col("type").isin(*wanted)
    return ~c if no else c


def terms_of(text: str) -> tuple[str, ...]:
    """Consequence terms by name, accession (with or without SO:) or group."""
    names = {a: t for t, a in V.ACCESSIONS.items()}
    groups = {"lof": V.LOF, "loss_of_function": V.LOF, "pa": V.PROTEIN_ALTERING, "protein_altering": V.PROTEIN_ALTERING}
    out: dict[str, None] = {}
    for v in L.terms(text).values:
        number = v[3:] if v.upper().startswith("SO:") else v
        if v.lower() in groups:
            out |= dict.fromkeys(groups[v.lower()])
        elif number.isdigit():
            out[_known(f"SO:{int(number):07d}", tuple(names)) and names[f"SO:{int(number):07d}"]] = None
        else:
            out[_known(v, tuple(V.ACCESSIONS))] = None
    return tuple(out)


def genotypes(text: str) -> tuple[list[str], list[str], list[str], bool]:
    """Literal genotypes, patterns, class names of a list, and whether it is negated.

    An unphased genotype stands for its phased forms too. Alleles beyond the first alternate stand for any such allele.
    """
    values = tuple(text.split(","))
    no = L.same_sign(values)
    literal, patterns, classes = [], [], []
    for v in (x.lstrip("!") for x in values):
        if v[:1].isalpha() and v != "NA":
            classes.append(_known(v, V.CLASSES))
            continue
        alleles = V.SEPARATOR.split(v)
        forms = [v, "/".join(reversed(alleles)), "|".join(alleles), "|".join(reversed(alleles))] if "/" in v else [v]
        if any(a.isdigit() and int(a) > 1 for a in alleles):
            for f in forms:
                patterns.append("".join(r"([2-9]|[1-9]\d+)" if a.isdigit() and int(a) > 1 else {"|": r"\|", ".": r"\."}.get(a, a) for a in V.PIECES.findall(f)))
        else:
            literal += forms
    return sorted(set(literal)), sorted(set(patterns)), classes, no


def has_genotype(gt: Column, text: str) -> tuple[Column, bool]:
    """Whether gt is one of a list of genotypes and classes, and whether the list is negated."""
    literal, patterns, classes, no = genotypes(text)
    tests = [gt.isin(*literal)] if literal else []
    tests += [gt.rlike(f"^({p})$") for p in patterns] + [V.is_class(gt, c) for c in classes]
    return F.coalesce(V.any_of(tests), F.lit(False)), no


def _of_sample(c, name: str) -> Column:
    """A sample by its number or its name."""
    return c["sample"] == int(name) if name.isdigit() else c["name"] == name


def _call_field(c, t: L.Comparison) -> Column:
    """A field of a call: false where it is missing."""
    key = t.key.lower()
    if key == "filter":
        if t.op not in ("=", "==", "!="):
            raise L.LanguageError(f"FILTER is compared by = and != only, not {t.op!r}")
        held = F.array_contains(c["filter"], t.value)
        return F.coalesce(held if t.op != "!=" else ~held, F.lit(False))
    if key == "gt":
        hit, no = has_genotype(c["gt"], t.value)
        return ~hit if no != (t.op == "!=") else hit
    return V.row_compare(c[_known(key, ("dp", "gq", "qual", "phased", "file", "sample"))], t.op, t.value)


class Compiler:
    """exists(table, test): whether a row of the table that belongs to the variant passes the test."""

    def __init__(self, exists: Callable[[str, Callable], Column], pedigrees: dict[str, dict] | None = None):
        self.exists, self.pedigrees = exists, pedigrees or {}

    def consequences(self, params: dict) -> Column | None:
        """Gene, biotype, term and flag hold on one and the same consequence."""
        tests = []
        if "gene" in params:
            genes = L.terms(params["gene"]).values
            tests.append(lambda c: c["gene"].isin(*genes) | c["transcript"].isin(*genes))
        if "biotype" in params:
            biotypes = L.terms(params["biotype"]).values
            tests.append(lambda c: c["biotype"].isin(*biotypes))
        if "ct" in params:
            terms = terms_of(params["ct"])
            tests.append(lambda c: c["term"].isin(*terms))
        if "transcriptFlag" in params:
            flags = [_known(f, FLAGS) for f in L.terms(params["transcriptFlag"]).values]
            tests.append(lambda c: c["flag"].isin(*flags))
        return self.exists("cts", lambda c: V.all_of([t(c) for t in tests])) if tests else None

    def clinical(self, params: dict) -> Column | None:
        """Source, significance and status hold on one piece of evidence; of several sources each must have one."""
        common = []
        if "clinicalSignificance" in params:
            wanted = [v.lower().replace(" ", "_") for v in L.terms(params["clinicalSignificance"]).values]
            common.append(lambda e: e["significance"].isin(*wanted))
        if "clinicalConfirmedStatus" in params:
            status = {"true": "confirmed", "false": "not_confirmed"}[str(params["clinicalConfirmedStatus"]).lower()]
            common.append(lambda e: e["status"] == status)
        if not common and "clinical" not in params:
            return None
        sources = L.terms(params["clinical"]).values if "clinical" in params else (None,)

        def from_source(source: str | None) -> Column:
            named = [] if source is None else [lambda e: e["source"] == source]
            return self.exists("evidence", lambda e: V.all_of([t(e) for t in named + common]))

        return V.all_of([from_source(s) for s in sources])

    def genotype(self, text: str) -> Column:
        wanted, by = L.by_key(text)

        def of(sample: str, values: list[str]) -> Column:
            no = genotypes(",".join(values))[-1]
            hit = self.exists("calls", lambda c: _of_sample(c, sample) & has_genotype(c["gt"], ",".join(values))[0])
            return ~hit if no else hit

        return _joined([of(s, v) for s, v in wanted.items()], by)

    def sample(self, text: str) -> Column:
        """Carriers of the main alternate; 'sample:genotypes', or 'sample:mode' where the sample's parents are known."""
        if ":" not in text:
            return _listed(text, lambda s: self.exists("calls", lambda c: _of_sample(c, s) & V.carries(c["gt"])))
        wanted, by = L.by_key(text)
        if not any(I.mode_name(v) in I.MODES for vs in wanted.values() for v in vs):
            return self.genotype(text)
        return _joined([V.any_of([self.segregation(s, v) for v in vs]) for s, vs in wanted.items()], by)

    def segregation(self, child: str, mode: str) -> Column:
        """The genotypes of a child and its parents fit a mode of inheritance; one without a call is HOM_REF."""
        if child not in self.pedigrees:
            raise L.LanguageError(f"no parents are known of {child!r}")
        people = {"child": child} | {r: self.pedigrees[child].get(r) for r in ("father", "mother")}
        alternatives = []
        for rule in I.MODES[_known(I.mode_name(mode), tuple(I.MODES))]:
            tests = [I.on_chromosomes(F.col("chrom"), rule.chromosomes)]
            for role, allowed in zip(("child", "father", "mother"), rule.classes):
                who = people[role]
                if who is None or allowed is None:
                    continue
                seen = self.exists("calls", lambda c, who=who, allowed=allowed: _of_sample(c, str(who)) & V.genotype_class(c["gt"]).isin(*sorted(allowed)))
                if "HOM_REF" in allowed:
                    seen = seen | ~self.exists("calls", lambda c, who=who: _of_sample(c, str(who)))
                tests.append(seen)
            alternatives.append(V.all_of(tests))
        return V.any_of(alternatives)

    def fields(self, text: str, table: str, is_named: Callable, field: Callable) -> Column:
        """'12:dp>20,gq>=10;13:dp>5': comparisons by sample or file, with one operator between names and one within a name."""
        groups, between, within = L.grouped(text)
        return _joined([self.exists(table, lambda c, n=n, ts=ts: is_named(c, n) & _joined([field(c, t) for t in ts], within)) for n, ts in groups], between)

    def xref(self, text: str) -> Column:
        """An id, a locus, an accession, a source of evidence, a gene trait or protein keyword, else a gene or transcript."""

        def test(v: str) -> Column:
            if len(v.split(":")) == 4:
                return id_condition(v)
            if v.startswith("rs"):
                return F.coalesce(F.col("rs") == v, F.lit(False))
            if v in ("clinvar", "cosmic"):
                return self.exists("evidence", lambda e: e["source"] == v)
            if v.startswith(("HP:", "OMIM:", "umls:")):
                return F.exists("gene_traits", lambda t: t["id"] == v)
            return self.exists("cts", lambda c: (c["gene"] == v) | (c["transcript"] == v))

        return _listed(text, test)

    def substitution(self, text: str) -> Column:
        """Sift and polyphen by score, or by description where the value is no number."""

        def of(c: L.Comparison) -> Column:
            name = _known(c.key, SUBSTITUTION)
            if V.is_number(c.value):
                return self.exists("cts", lambda x: V.compare(x[name], c.op, float(c.value)))
            if c.op not in ("=", "==", "!="):
                raise L.LanguageError(f"a description is compared by = and != only, not {c.op!r}")
            hit = self.exists("cts", lambda x: x[f"{name}_text"] == c.value)
            return ~hit if c.op == "!=" else hit

        found, by = L.comparisons(text)
        return _joined([of(c) for c in found], by)

    def stats(self, text: str, field: str) -> Column:
        """'study:cohort<0.1' over a cohort's statistics; operators that include missing values hold where there are none."""

        def of(c: L.Comparison) -> Column:
            study, cohort = L.scoped(c.key)
            here = self.exists("stats", lambda s: (s["cohort"] == cohort) & V.compare(s[field], c.op, _number(c)))
            if c.op in WITH_MISSING:
                here = here | ~self.exists("stats", lambda s: s["cohort"] == cohort)
            return here if study is None else here & (F.col("study") == study)

        found, by = L.comparisons(text)
        return _joined([of(c) for c in found], by)

    def cohort(self, text: str) -> Column:
        def test(v: str) -> Column:
            study, cohort = L.scoped(v)
            here = self.exists("stats", lambda s: s["cohort"] == cohort)
            return here if study is None else here & (F.col("study") == study)

        return _listed(text, test)

    def one(self, name: str, value) -> Column:
        """The condition of one parameter that does not depend on others."""
        t = value
        by_column = lambda c: _listed(t, lambda v: F.col(c) == v)
        if name in LEGACY:
            return self.one(LEGACY[name], ",".join(f"{name}{x}" if x[0] in "<>=!" else f"{name}={x}" for x in L.terms(t).values) if name in SUBSTITUTION else t)
        stats = {"cohortStatsRef": "ref_freq", "cohortStatsAlt": "alt_freq", "cohortStatsMaf": "maf", "cohortStatsMgf": "mgf", "cohortStatsPass": "pass_freq", "missingAlleles": "missing_alleles", "missingGenotypes": "missing_genotypes"}
        if name in stats:
            return self.stats(t, stats[name])
        if name.startswith("populationFrequency"):
            return frequency_condition(t, _known(name.removeprefix("populationFrequency"), ("Alt", "Ref", "Maf")).lower())
        make = {
            "id": lambda: id_condition(t),
            "reference": lambda: by_column("reference"),
            "alternate": lambda: by_column("alternate"),
            "type": lambda: type_condition(t),
            "study": lambda: by_column("study"),
            "genotype": lambda: self.genotype(t),
            "sample": lambda: self.sample(t),
            "sampleData": lambda: self.fields(t, "calls", _of_sample, _call_field),
            "file": lambda: _listed(t, lambda v: self.exists("calls", lambda c: c["file"] == v)),
            "fileData": lambda: self.fields(t, "calls", lambda c, n: c["file"] == n, _call_field),
            "filter": lambda: self.exists("calls", lambda c: _listed(t, lambda v: F.array_contains(c["filter"], v))),
            "qual": lambda: self.exists("calls", lambda c: _joined([V.row_compare(c["qual"], x.op, x.value) for x in L.comparisons(t)[0]], L.comparisons(t)[1])),
            "cohort": lambda: self.cohort(t),
            "score": lambda: _numbers(t, lambda k: F.try_element_at("scores", F.lit(k))),
            "release": lambda: F.col("release") <= int(t),
            "annotationExists": lambda: self.exists("cts", lambda c: c["gene"].isNotNull() | F.lit(True)) == (str(t).lower() == "true"),
            "xref": lambda: self.xref(t),
            "proteinSubstitution": lambda: self.substitution(t),
            "conservation": lambda: _numbers(t, lambda k: F.try_element_at("conserved", F.lit(_known(k, CONSERVATION)))),
            "functionalScore": lambda: _numbers(t, lambda k: F.try_element_at("functional", F.lit(_known(k, FUNCTIONAL)))),
            "trait": lambda: _listed(t, lambda v: F.coalesce(F.col("trait").contains(v.lower()), F.lit(False))),
            "geneTraitId": lambda: _listed(t, lambda v: F.exists("gene_traits", lambda x: x["id"] == v)),
            "geneTraitName": lambda: _listed(t, lambda v: F.exists("gene_traits", lambda x: x["name"] == v)),
            "hpo": lambda: _listed(t, lambda v: F.exists("gene_traits", lambda x: x["id"] == v)),
            "drug": lambda: _listed(t, lambda v: F.array_contains("drugs", v)),
            "proteinKeyword": lambda: _listed(t, lambda v: F.array_contains("keywords", v)),
            "customAnnotation": lambda: _joined([V.row_compare(F.try_element_at("custom", F.lit(x.key)), x.op, x.value) for x in L.comparisons(t)[0]], L.comparisons(t)[1]),
            "family": lambda: _listed(t, lambda f: V.any_of([self.exists("calls", lambda c, s=s: _of_sample(c, str(s)) & V.carries(c["gt"])) for s in self.family(f)])),
            "source": lambda: F.lit(_known(t, SOURCES) is not None),
        }
        if name not in make:
            raise L.LanguageError(f"unknown parameter {name!r}")
        return make[name]()

    def family(self, name: str) -> list:
        """The members of a family: the child that it is named by, or all children of that family, and their parents."""
        members = [x for child, p in self.pedigrees.items() if name in (p.get("family"), child) for x in (child, p.get("father"), p.get("mother")) if x is not None]
        if not members:
            raise L.LanguageError(f"unknown family {name!r}")
        return members

    def condition(self, params: dict) -> Column:
        """All parameters together. Region and id are alternatives of place; a gene without one is a place of its own."""
        rest = dict(params)
        out, places = [], []
        if "region" in rest:
            places.append(region_condition([L.region(v) for v in L.terms(rest.pop("region")).values], contained=bool(rest.pop("regionStartOnly", False))))
        if "id" in rest:
            places.append(id_condition(rest.pop("id")))
        nested = {k: rest.pop(k) for k in ("gene", "biotype", "ct", "transcriptFlag") if k in rest}
        if places and "gene" in nested:
            others = {k: v for k, v in nested.items() if k != "gene"}
            near = V.any_of(places)
            if (c := self.consequences(others)) is not None:
                near = near & c
            out.append(near | self.consequences(nested))
        else:
            if places:
                out.append(V.any_of(places))
            if (c := self.consequences(nested)) is not None:
                out.append(c)
        if "familySegregation" in rest:
            mode = rest.pop("familySegregation")
            children = [c for f in L.terms(rest.pop("family")).values for c, p in self.pedigrees.items() if f in (p.get("family"), c)]
            if not children:
                raise L.LanguageError("familySegregation needs a known family")
            out += [self.segregation(c, mode) for c in children]
        clinical = {k: rest.pop(k) for k in ("clinical", "clinicalSignificance", "clinicalConfirmedStatus") if k in rest}
        if (c := self.clinical(clinical)) is not None:
            out.append(c)
        out += [self.one(k, v) for k, v in rest.items()]
        return V.all_of(out) if out else F.lit(True)


def frequency_condition(text: str, kind: str) -> Column:
    """'study:population<0.01' for alt, ref or maf; a missing frequency is 0 (ref: 1)."""

    def of(c: L.Comparison) -> Column:
        if ":" not in c.key:
            raise L.LanguageError(f"no study:population in {text!r}")
        alt = F.coalesce(F.try_element_at("pops", F.lit(c.key)), F.lit(0.0))
        return V.compare({"alt": alt, "ref": 1 - alt, "maf": V.minor(alt)}[kind], c.op, _number(c))

    found, by = L.comparisons(text)
    return _joined([of(c) for c in found], by)


def condition(params: dict, pedigrees: dict[str, dict] | None = None) -> Column:
    """The condition over rows with nested arrays cts, evidence, calls and stats."""
    return Compiler(lambda table, test: F.exists(table, lambda c: F.coalesce(test(c), F.lit(False))), pedigrees).condition(params)


class _Fields:
    """The columns of a table, asked for as the fields of a nested row are."""

    def __getitem__(self, name: str) -> Column:
        return F.col(name)


def select(variants: DataFrame, tables: dict[str, Callable[[], DataFrame]], params: dict, pedigrees: dict[str, dict] | None = None, knowledge: DataFrame | None = None) -> DataFrame:
    """The variants that hold, from tables by variant key instead of nested rows.

    Of each table only the rows that some condition names are kept; they are grouped to one flag a condition and variant.
    knowledge: rows of kind, term and gene, which resolve gene sets; a set without genes holds for no variant.
    """
    params = dict(params)
    for kind in [k for k in GENE_SETS if k in params]:
        wanted = L.terms(params.pop(kind)).values
        genes = knowledge.filter((F.col("kind") == kind) & F.col("term").isin(*wanted)).select("gene").distinct()
        hits = tables["cts"]().join(genes, "gene", "left_semi").select("key").distinct()
        variants = variants.join(hits, "key", "left_semi")
    asked: dict[str, list[Column]] = {}

    def exists(table: str, test: Callable) -> Column:
        tests = asked.setdefault(table, [])
        tests.append(F.coalesce(test(_Fields()), F.lit(False)))
        return F.coalesce(F.col(f"_{table}_{len(tests) - 1}"), F.lit(False))

    params, variants = _many_regions(variants, params)
    holds = Compiler(exists, pedigrees).condition(params)
    for table, tests in asked.items():
        names = [f"_{table}_{k}" for k in range(len(tests))]
        some = tables[table]().filter(V.any_of(tests))
        flags = some.groupBy("key").agg(*(F.max(t).alias(n) for t, n in zip(tests, names)))
        variants = variants.join(flags, "key", "left")
    return variants.filter(holds).drop(*(f"_{table}_{k}" for table, tests in asked.items() for k in range(len(tests))))


def _many_regions(rows: DataFrame, params: dict) -> tuple[dict, DataFrame]:
    """Many regions are joined by bins instead of spelled out."""
    regions = [L.region(v) for v in L.terms(params["region"]).values] if "region" in params else []
    if len(regions) <= MANY_REGIONS or "gene" in params or "id" in params or any(r.end is None for r in regions):
        return params, rows
    from ..operators import overlap

    track = rows.sparkSession.createDataFrame([(r.chrom, r.start, r.end) for r in L.merged(regions)], "chrom string, start long, end long")
    hit = overlap.overlaps(rows.select("key", "chrom", "start", "end"), track).select("key").distinct()
    return {k: v for k, v in params.items() if k not in ("region", "regionStartOnly")}, rows.join(hit, "key", "left_semi")


def query(rows: DataFrame, params: dict, limit: int | None = None, skip: int = 0, sort: bool = False, pedigrees: dict[str, dict] | None = None) -> DataFrame:
    """Nested rows that hold. limit and skip count in locus order."""
    if limit is not None and limit < 0 or skip < 0:
        raise L.LanguageError("limit and skip are not negative")
    params, rows = _many_regions(rows, dict(params))
    rows = rows.filter(condition(params, pedigrees))
    if sort or limit is not None or skip:
        rows = rows.orderBy(V.chrom_order("chrom"), "start", "end", "reference", "alternate", "key")
    if skip:
        rows = rows.offset(skip)
    return rows if limit is None else rows.limit(limit)
