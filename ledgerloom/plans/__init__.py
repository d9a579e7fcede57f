"""Registered queries and their DuckDB equivalents."""

from ledgerloom.plans import articles, dedup, extraction, feeds, forms, landed, pages, people, predicates, projections, registries, saving, serving, tables, upkeep, validation  # noqa: F401
from ledgerloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "res03_duplicate_groups"
