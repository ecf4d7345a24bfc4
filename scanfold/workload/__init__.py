"""Registered queries: each key has a Spark query and, where possible, a DuckDB one."""

QUERIES: dict = {}
ORACLE: dict = {}


def query(key: str, sql: str | None = None):
    """Register a Spark query under a key, with the DuckDB text that must agree."""
    def register(function):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = function
        if sql is not None:
            ORACLE[key] = sql
        return function
    return register


def load() -> None:
    from scanfold.workload import (baseline, hosts, memory, models, ports, predictions,  # noqa: F401
                                   sources, streams)
