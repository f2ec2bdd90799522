"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_BATCH = 2000
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a folder of our own on a local master, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="recallgrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def packed(docs: DataFrame) -> Column:
    """The whole row as one struct column: working columns beside it can't clash with the row's own names; select("doc.*") unpacks it."""
    return F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc")


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """At most n rows in an Arrow batch of the jobs inside, for columns of long values."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, min(n, int(before or n)))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/recallgrid-{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def new_table(label: str) -> str:
    name = f"recallgrid_{label}_{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(name)
    return name


def remove(spark: SparkSession, *names: str) -> None:
    """Deletes folders, and drops tables of the catalog."""
    for name in names:
        if "/" not in name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            continue
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are removed at the end; what was made of them must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        remove(spark, *_scopes.pop())


def stored(df: DataFrame, label: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write df once and read it back: cuts lineage, and what was non-deterministic is fixed.

    replaces is a stored table that nothing needs any more once df is written; it is removed.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    with arrow_rows(spark, ROWS_A_BATCH):
        df.write.option("compression", "zstd").parquet(path)
    if replaces is not None:
        remove(spark, *{f.rpartition("/")[0] for f in replaces.inputFiles()})
    return spark.read.schema(df.schema).parquet(path)
