"""Registered queries and their DuckDB formulations."""

from __future__ import annotations

from . import codebase, conflicts, diagnostics, evidence, governance, insight, relations, retrieval, stored, streams, tables, trees

MODULES = (retrieval, relations, governance, tables, insight, codebase, conflicts, diagnostics, evidence, streams, trees, stored)
QUERIES: dict = {}
ORACLES: dict = {}
for _module in MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
