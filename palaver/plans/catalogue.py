"""Registry of the engine's queries and of the SQL that states each result independently."""

from __future__ import annotations

from palaver.plans import answers, attributions, base, graphs, jobs, models, searches, segmenting, timelines  # noqa: F401  they register


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.SQL)
