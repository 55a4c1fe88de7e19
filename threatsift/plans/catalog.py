"""Registry of named queries: Spark plan + (optional) DuckDB oracle text.

Each query is ``fn(spark, sf_dir) -> DataFrame``; its oracle (if the
operator is SQL-expressible) is a SQL string over the driver's table names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, Callable[[], str]] = {}
HEADLINE: list[str] = []


def query(key: str, oracle: Callable[[], str] | None = None, headline: bool = False):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            from threatsift.session import ship_package
            ship_package(spark)  # executor Python workers need the package
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if oracle is not None:
            ORACLE[key] = oracle
        if headline:
            HEADLINE.append(key)
        return fn

    return deco


def load_all() -> None:
    """Import every query module so the registry is complete."""
    from threatsift.plans import (  # noqa: F401
        q_clean,
        q_explain,
        q_functions,
        q_history,
        q_occlusion,
        q_profile,
        q_quality,
        q_sample,
        q_scoring,
        q_sources,
        q_streaming,
        q_triage,
        q_vocabulary,
    )
