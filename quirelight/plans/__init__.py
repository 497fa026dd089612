"""The queries of the library, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from quirelight.plans import access, assembly, contents, layouts, matching, merges, rules, search, shapes, shelves, streams, tables, texts, timelines  # noqa: F401  they register their queries
from quirelight.plans.registry import ORACLE, QUERIES, Query

FLAGSHIP = "text_search"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
