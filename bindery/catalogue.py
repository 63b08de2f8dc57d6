"""The registered queries and their SQL."""

from __future__ import annotations

from .plans import books, lookups, made, relations, scalars, validated  # noqa: F401  they register what they define
from .plans.registry import QUERIES, SQL, Query

FLAGSHIP = "reader_append_non_linear"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
