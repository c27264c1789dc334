"""Registered queries with their SQL."""

from __future__ import annotations

from . import choosing, columns, following, gridding, inputs, jobs, joining, measuring, motion, registry, sampling, scoring, studying, suite_building, suites  # noqa: F401


def all_queries() -> dict:
    return dict(registry.QUERIES)


def all_sql() -> dict[str, str]:
    return dict(registry.SQL)
