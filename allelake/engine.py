"""The façade: query, count, facet and statistics over one set of tables."""

from __future__ import annotations

import concurrent.futures
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import variant as V
from .operators import stats
from .plans import facets, filters
from .plans import language as L

#: Pages are so long by default and at most.
DEFAULT_LIMIT, MOST = 1000, 5000


class Engine:
    """rows: a function from the names of nested arrays to variant rows that hold them."""

    def __init__(self, rows: Callable[[tuple[str, ...]], DataFrame], calls: DataFrame, members: DataFrame):
        self.rows, self.calls, self.members = rows, calls, members

    def query(self, params: dict, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), limit: int | None = DEFAULT_LIMIT, skip: int = 0) -> DataFrame:
        """A page of rows in locus order, with the columns included or without those excluded; fields of a nested array as 'cts.gene'."""
        if limit is not None and limit > MOST:
            raise L.LanguageError(f"no page is longer than {MOST}")
        nested = {c.split(".")[0] for c in include} & set(filters.LOOKS_INTO)
        rows = filters.query(self.rows(tuple({*filters.parts(params), *nested})), params, limit, skip)
        return project(rows, include, exclude)

    def count(self, params: dict) -> int:
        return filters.query(self.rows(filters.parts(params)), params).count()

    def approximate_count(self, params: dict, exact: dict, sample: int = 1000) -> tuple[int, int]:
        """Rows that hold, from the share that the rest of the parameters keeps of a sample of what exact alone finds, and the sample's size."""
        primary = filters.query(self.rows(tuple({*filters.parts(params), *filters.parts(exact)})), exact)
        taken = primary.orderBy(F.xxhash64("key")).limit(sample)
        rest = {k: v for k, v in params.items() if k not in exact}
        total = primary.count()
        n, kept = taken.agg(F.count(F.lit(1)), F.count(F.when(filters.condition(rest), 1))).first()
        return (round(total * kept / n) if n else 0), n

    def page_and_count(self, params: dict, limit: int = DEFAULT_LIMIT, skip: int = 0) -> tuple[list, int]:
        """A page and the count of all rows, by two jobs side by side."""
        with concurrent.futures.ThreadPoolExecutor(2) as pool:
            total = pool.submit(self.count, params)
            return self.query(params, limit=limit, skip=skip).collect(), total.result()

    def facet(self, params: dict, text: str) -> dict[str, DataFrame]:
        needed = {*filters.parts(params), *(p for levels in L.facets(text) for p in facets.parts(levels))}
        return facets.facets(filters.query(self.rows(tuple(needed)), params), text)

    def cohort_stats(self) -> DataFrame:
        return stats.cohort_stats(self.calls, self.members)

    def samples(self, params: dict) -> DataFrame:
        """Samples that carry any of the variants."""
        hits = filters.query(self.rows(filters.parts(params)), params).select("key")
        return self.calls.filter(V.carries(F.col("gt"))).join(hits, "key", "left_semi").select("sample").distinct()


def project(rows: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Columns included, or all but those excluded; 'array.field' reaches into the structs of an array."""
    if include:
        plain = [c for c in include if "." not in c]
        nested: dict[str, list[str]] = {}
        for c in include:
            if "." in c:
                nested.setdefault(c.split(".")[0], []).append(c.split(".")[1])
        return rows.select(*plain, *(_only(a, fields) for a, fields in nested.items()))
    for c in exclude:
        rows = rows.withColumn(c.split(".")[0], _without(c.split(".")[0], c.split(".")[1])) if "." in c else rows.drop(c)
    return rows


def _only(array: str, fields: list[str]):
    return F.transform(array, lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias(array)


def _without(array: str, field: str):
    return F.transform(array, lambda x: x.dropFields(field))
