"""A sample index by codes of a few bits, and filters that it answers exactly or not."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variant as V
from . import language as L


@dataclass(frozen=True)
class Ranges:
    """A number as the count of thresholds that it reaches; missing values have a code of their own."""

    thresholds: tuple[float, ...]

    def code(self, value: Column) -> Column:
        reached = F.lit(0)
        for t in self.thresholds:
            reached = reached + (value >= t).cast("int")
        return F.coalesce(reached + 1, F.lit(0)).cast("byte")

    def test(self, code: Column, op: str, bound: float) -> tuple[Column, Column]:
        """Whether a code holds for certain, and whether only the value can tell."""
        below = sum(t <= bound for t in self.thresholds) + 1
        exact = bound in self.thresholds
        if op in (">", ">="):
            sure = code >= below if exact and op == ">=" else code > below
            return sure, F.lit(False) if exact and op == ">=" else code == below
        if op in ("<", "<="):
            sure = (code < below) & (code > 0)
            return sure, F.lit(False) if exact and op == "<" else code == below
        return F.lit(False), code == below


@dataclass(frozen=True)
class Values:
    """Values as bits; others share the last one."""

    names: tuple[str, ...]

    def code(self, values: Column) -> Column:
        bits = F.lit(0)
        for i, n in enumerate(self.names):
            bits = bits.bitwiseOR(F.when(F.array_contains(values, n), 1 << i).otherwise(0))
        other = F.exists(values, lambda v: ~v.isin(*self.names))
        return F.coalesce(bits.bitwiseOR(F.when(other, 1 << len(self.names)).otherwise(0)), F.lit(0))

    def test(self, code: Column, op: str, value: str) -> tuple[Column, Column]:
        no = op == "!="
        if value not in self.names:
            other = code.bitwiseAND(1 << len(self.names)) != 0
            return (~other, other) if no else (F.lit(False), other)
        hit = code.bitwiseAND(1 << self.names.index(value)) != 0
        return (~hit if no else hit), F.lit(False)


@dataclass(frozen=True)
class Config:
    """Fields of the index by name. The defaults are fixed values."""

    fields: dict[str, Ranges | Values] = field(default_factory=lambda: {"dp": Ranges((5, 10, 15, 20, 30, 50)), "qual": Ranges((10, 20, 30)), "filter": Values(("PASS",))})


def build(calls: DataFrame, config: Config = Config()) -> DataFrame:
    """Calls of the index: key, sample, gt and a code for each field, as a column code_<field>."""
    return calls.select("key", "sample", "gt", *(f.code(F.col(n)).alias(f"code_{n}") for n, f in config.fields.items()))


def select(index: DataFrame, calls: DataFrame, text: str, config: Config = Config()) -> DataFrame:
    """Entries (key, sample) for which all or any of the comparisons hold.

    Those that the codes decide come from the index alone; only entries that no code decides are looked up in the calls.
    """
    found, by = L.comparisons(text)
    sure, open_ = [], []
    for c in found:
        if c.key not in config.fields:
            raise L.LanguageError(f"the index has no field {c.key!r}")
        of = config.fields[c.key]
        s, o = of.test(F.col(f"code_{c.key}"), c.op, float(c.value) if isinstance(of, Ranges) else c.value)
        sure.append(s)
        open_.append(o)
    if by == L.AND:
        certain, maybe = V.all_of(sure), V.all_of([s | o for s, o in zip(sure, open_)])
    else:
        certain, maybe = V.any_of(sure), V.any_of([s | o for s, o in zip(sure, open_)])
    values = [F.coalesce(F.array_contains(c.key, c.value) == (c.op != "!="), F.lit(False)) if isinstance(config.fields[c.key], Values) else V.row_compare(F.col(c.key), c.op, c.value) for c in found]
    held = V.all_of(values) if by == L.AND else V.any_of(values)
    decided = index.filter(certain).select("key", "sample")
    unsure = index.filter(maybe & ~certain).select("key", "sample")
    return decided.unionByName(calls.join(unsure, ["key", "sample"], "left_semi").filter(held).select("key", "sample"))
