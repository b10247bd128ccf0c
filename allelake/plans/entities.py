"""Filters over catalogue entities: columns by name, with the comparisons of the metadata store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import variant as V
from . import language as L


def _one(rows: DataFrame, column: str, value: str) -> Column:
    kind = rows.schema[column].dataType
    found = L.operator_at(value)
    op, bound = (found[1], value[len(found[1]) :].strip()) if found and found[0] == 0 else ("=", value)
    c = F.col(column)
    if isinstance(kind, T.ArrayType):
        return F.exists(column, lambda x: V.row_compare(x, op, bound))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c == (bound.lower() == "true"), F.lit(False))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):  # 2020, 202003, 20200315 and ranges of them
        low, _, high = bound.partition("-")
        day = F.date_format(c, "yyyyMMdd")
        if op in ("=", "=="):
            return F.coalesce((day >= low.ljust(8, "0")) & (day <= (high or low).ljust(8, "9")), F.lit(False))
        return V.row_compare(day, op, (low.ljust(8, "0")))
    return V.row_compare(c, op, bound)


def select(rows: DataFrame, params: dict) -> DataFrame:
    """Entities that hold for all parameters; of the values of one, ',' any and ';' all. A name that is no column is an error."""
    out = []
    for name, text in params.items():
        if name not in rows.columns:
            raise L.LanguageError(f"no field {name!r}")
        found = L.terms(text)
        # '!x' is the contrary of x, while '!=' and '!~' are operators.
        tests = [~_one(rows, name, v[1:]) if v.startswith("!") and v[1:2] not in ("=", "~") else _one(rows, name, v) for v in found.values]
        out.append(V.all_of(tests) if found.joined_by == L.AND else V.any_of(tests))
    return rows.filter(V.all_of(out))
