"""All queries over the reference's operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from tallyworks.operators import assessments, checks, documents, items, listings, portfolio, recurring, retrieval, risk, trends, words
from tallyworks.sources import files, sinks, versions
from tallyworks.streaming import counters, gate, ingest, telemetry

_MODULES = (trends, portfolio, items, checks, recurring, retrieval, risk, assessments, listings, documents, words, files, sinks, versions, counters, gate, ingest, telemetry)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
