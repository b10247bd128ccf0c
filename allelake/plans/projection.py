"""What of a variant's calls a query returns: samples, files, fields, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import language as L

ALL, NONE = "all", "none"
#: Samples are paged so by default and at most.
SAMPLE_LIMIT, SAMPLE_MOST = 100, 1000


def included(text: str | None, default: tuple[str, ...] | None = None) -> tuple[str, ...] | None:
    """The names of an include-list; None for all of them. Without a list the default holds; 'all' and 'none' stand alone."""
    if text is None:
        return default
    names = L.terms(text).values
    if {ALL, NONE} & set(names) and len(names) > 1:
        raise L.LanguageError(f"{ALL!r} and {NONE!r} stand alone: {text!r}")
    return None if names == (ALL,) else () if names == (NONE,) else names


def filtered_samples(params: dict) -> tuple[str, ...] | None:
    """Samples that the filters name, which are returned unless a list says otherwise."""
    out: dict[str, None] = {}
    for name in ("sample", "genotype", "sampleData"):
        if name in params:
            for v in L.split(params[name], L.AND + L.OR):
                head, colon, _ = v.partition(":")
                if name == "sample" or colon:
                    out[head.lstrip("!")] = None
    return tuple(out) or None


def project(rows: DataFrame, params: dict) -> DataFrame:
    """Rows with the array calls as includeSample, includeFile, includeSampleData, includeGenotype, unknownGenotype, sampleLimit and sampleSkip want it.

    Samples are in the order of their numbers. With unknownGenotype a listed sample without a call has that genotype and
    no other field. Samples are named by number or name.
    """
    samples = included(params.get("includeSample"), filtered_samples(params))
    files = included(params.get("includeFile"))
    limit, skip = params.get("sampleLimit"), params.get("sampleSkip", 0)
    if skip < 0 or (limit is not None and not 0 <= limit <= SAMPLE_MOST):
        raise L.LanguageError(f"a page of samples is no longer than {SAMPLE_MOST} and starts at 0 or later")
    calls = F.col("calls")
    if samples is not None:
        numbers, names = [int(s) for s in samples if s.isdigit()], [s for s in samples if not s.isdigit()]
        calls = F.filter(calls, lambda c: c["sample"].isin(*numbers) | c["name"].isin(*names)) if samples else F.slice(calls, 1, 0)
    if files is not None:
        calls = F.filter(calls, lambda c: c["file"].isin(*files))
    calls = F.array_sort(calls, lambda a, b: F.when(a["sample"] < b["sample"], -1).when(a["sample"] > b["sample"], 1).otherwise(0))
    rows = rows.withColumn("calls", calls)
    fields = list(included(params.get("includeSampleData"), ("gt",)) or [f for f in rows.schema["calls"].dataType.elementType.names if f not in ("sample", "name", "file")])
    if str(params.get("includeGenotype", "true")).lower() == "false":
        fields = [f for f in fields if f != "gt"]
    kept = F.transform("calls", lambda c: F.struct(c["name"].alias("name"), *(c[f].alias(f) for f in fields)))
    if (unknown := params.get("unknownGenotype")) is not None and samples and "gt" in fields:
        names = F.array(*map(F.lit, samples))
        kinds = {f.name: f.dataType for f in rows.schema["calls"].dataType.elementType.fields}
        blank = lambda n: F.struct(n.alias("name"), *((F.lit(unknown) if f == "gt" else F.lit(None).cast(kinds[f])).alias(f) for f in fields))
        missing = F.filter(names, lambda n: ~F.exists("calls", lambda c: (c["name"] == n) | (c["sample"].cast("string") == n)))
        kept = F.concat(kept, F.transform(missing, blank))
    if limit is not None or skip:
        kept = F.slice(kept, skip + 1, SAMPLE_LIMIT if limit is None else limit)
    return rows.withColumn("calls", kept)
