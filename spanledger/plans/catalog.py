"""Registry of named queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanledger.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Lazy access to the given tables and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        builder = views.SPARK_VIEWS.get(name)
        if builder is not None:
            return builder(self)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def with_views(sql: str, needs: str = "") -> str:
    """Prefix ``sql`` with the view definitions it names, in dependency order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for parent in views.SQL_NEEDS.get(name, ()):
            add(parent)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        add(name)
    if not ordered:
        return sql
    head = ",\n".join(f"{name} AS ({views.SQL_VIEWS[name]})" for name in ordered)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None, needs: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = with_views(sql, needs)
        return fn

    return register
