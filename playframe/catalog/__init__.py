"""Registered queries: the Spark side and, where SQL can say the same, the SQL
that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Catalog:
    runs: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None):
        def keep(fn):
            self.runs[name] = fn
            if sql is not None:
                self.checks[name] = sql
            return fn

        return keep


def load() -> Catalog:
    """All groups in one catalogue."""
    from playframe.catalog import events, grids, joins, learning, play, space

    merged = Catalog()
    for group in (events, joins, space, grids, learning, play):
        merged.runs.update(group.catalog.runs)
        merged.checks.update(group.catalog.checks)
    return merged
