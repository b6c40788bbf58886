"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from lexloom.plans import catalogue, hybrid, ingest, metering, retrieval, statements

QUERIES: dict = dict(retrieval.QUERIES) | dict(statements.QUERIES) | dict(catalogue.QUERIES) | dict(hybrid.QUERIES) | dict(ingest.QUERIES) | dict(metering.QUERIES)
SQL: dict[str, str] = dict(retrieval.SQL) | dict(statements.SQL) | dict(catalogue.SQL) | dict(hybrid.SQL) | dict(ingest.SQL) | dict(metering.SQL)
