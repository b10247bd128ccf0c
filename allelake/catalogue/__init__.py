"""Queries by name, each with the SQL that it must agree with."""

from __future__ import annotations

from . import aggregates, extended, filters, joins, more, records, tools

FLAGSHIP = "a02_nested_facet"
MODULES = (filters, joins, aggregates, records, tools, more, extended)


def queries():
    return {n: q for m in MODULES for n, q in m.QUERIES.items()}


def oracle_sql():
    return {n: s for m in MODULES for n, s in m.ORACLE_SQL.items()}
