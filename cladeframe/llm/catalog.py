"""All queries of the subpackage."""

from __future__ import annotations

from cladeframe.llm import queries as q
from cladeframe.plans.registry import Query


def queries() -> dict[str, Query]:
    return dict(q.R.queries)


def oracle_sql() -> dict[str, str]:
    return dict(q.R.sql)
