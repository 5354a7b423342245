"""All queries of the form engine by name, and the SQL that checks them."""

from __future__ import annotations

from formgrain.plans import scoring_queries, table_queries  # noqa: F401  (the second registers its queries in the first)


def queries() -> dict:
    return dict(scoring_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(scoring_queries.SQL)
