"""Named queries, each beside the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from threadlens.plans.bridges import CTES, Tables
from threadlens.session import tune


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(tune(spark), folder))


REGISTRY: dict[str, Query] = {}


def sql_with(body: str, *ctes: str, extra: str = "", recursive: bool = False) -> str:
    """``body`` behind the named bridge CTEs and further CTE text."""
    parts = [CTES[name].strip() for name in ctes] + ([extra.strip()] if extra else [])
    if not parts:
        return body.strip()
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + body.strip()


def query(name: str, sql: str | None = None, *ctes: str, extra: str = "", recursive: bool = False):
    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        text = None if sql is None else sql_with(sql, *ctes, extra=extra, recursive=recursive)
        REGISTRY[name] = Query(name, build, text)
        return build

    return add
