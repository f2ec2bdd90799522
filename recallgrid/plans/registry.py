"""How queries are registered: a function of a view loader, and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures



class Loader:
    """Gives a view by name; place tells sessions and folders apart for what is kept from query to query."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.place = spark, sf_dir, (spark.sparkContext.applicationId, sf_dir)

    def __call__(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)


Views = Loader
MODULES = ("scans", "changes", "relations", "texts", "analytics", "exports")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, make: Callable[[Views], DataFrame], sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # all times of the tables are UTC
        return make(Loader(spark, sf_dir))

    if name in QUERIES:
        raise ValueError(f"{name} is there already")
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = fixtures.duck(sql.strip())


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def sql() -> dict[str, str]:
    _load()
    return dict(SQL)


def query_vector(v: Views) -> list[float]:
    """The query's embedding: one row, as from an embedding service."""
    row = v("embeddings").where(f"vec_id = {fixtures.QUERY_VECTOR}").select("embedding").first()
    return [float(x) for x in row[0]]
