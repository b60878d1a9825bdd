"""All registered queries of the library and their SQL."""

from __future__ import annotations

from quarry.plans import dumps, evaluation, findings, query_building, ranking, retrieval, text_work, usage, verification  # noqa: F401  they register themselves
from quarry.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
