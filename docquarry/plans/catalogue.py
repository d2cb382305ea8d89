"""All named queries but those of the corpus subpackage."""

from __future__ import annotations

from docquarry.plans import accounts, analytics, graphs, knowledge, rebuilt, relational, resolution, scalars, states, texts, vectors  # noqa: F401  they register
from docquarry.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
