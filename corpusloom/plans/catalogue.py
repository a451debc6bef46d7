"""The catalogue of queries on the test tables, each with its SQL."""

from __future__ import annotations

from corpusloom.plans import analysis, lexical, parsing, services, store, stored, voting


def queries() -> dict:
    return voting.QUERIES | store.QUERIES | lexical.QUERIES | analysis.QUERIES | stored.QUERIES | services.QUERIES | parsing.QUERIES


def oracle_sql() -> dict[str, str]:
    return voting.SQL | store.SQL | lexical.SQL | analysis.SQL | stored.SQL | services.SQL | parsing.SQL
