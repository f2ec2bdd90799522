"""Snapshots of the tables, by digests of ranges: what a snapshot shares with the one before it isn't written again.

A table's rows are dealt to ranges of their first column. A range's digest adds up hashes of its rows, so it
doesn't depend on their order and counts repeats. A snapshot is a manifest (table, range, rows, digest,
written); the rows lie below target/parts/<table>/written=<backup>/range=<n>, and a range whose digest the
newest manifest has is named there again. The manifest is written last, so what a killed backup left is
in no snapshot. One backup at a time writes to a target.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import stored
from ..schema import DDL
from .readers import read_table

RANGE_IDS = 100_000
KEY_RANGES = 16  # of tables whose first column is a text
FILES_A_RANGE = 8
MANIFEST = "table string, range long, rows long, digest string, written string"


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _list(spark: SparkSession, folder: str) -> list[str]:
    """Names of the snapshots in a folder, oldest first."""
    fs, path = _path(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    return [n for n in names if n.startswith("memory-") and fs.exists(_path(spark, f"{folder}/{n}/_SUCCESS")[1])]


def _range(rows: DataFrame, range_ids: int) -> Column:
    """The range of a row: null keys have their own."""
    key = rows.schema[0]
    number = F.pmod(F.xxhash64(key.name), F.lit(KEY_RANGES)) if key.dataType.typeName() == "string" else F.floor(F.col(key.name) / range_ids)
    return F.when(F.col(key.name).isNull(), -1).otherwise(number).cast("long").alias("range")


def digests(rows: DataFrame, range_ids: int = RANGE_IDS) -> DataFrame:
    """range, rows, digest: four sums, over a range's rows, of 60 bits each of a row's SHA-256."""
    sha = rows.select(_range(rows, range_ids), F.sha2(F.to_json(F.struct(*rows.columns)), 256).alias("sha"))
    part = lambda k: F.sum(F.conv(F.substring("sha", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return sha.groupBy("range").agg(F.count("*").alias("rows"), F.concat_ws("-", *(part(k) for k in range(4))).alias("digest"))


def _digests(spark: SparkSession, tables: str, range_ids: int) -> DataFrame:
    """digests of all tables; whether two ledgers are equal is asked of tables cut into ranges alike."""
    every = [digests(read_table(spark, tables, n), range_ids).select(F.lit(n).alias("table"), "range", "rows", "digest") for n in DDL]
    return reduce(DataFrame.unionByName, every)


def manifest(spark: SparkSession, snapshot: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(snapshot)


def backup(spark: SparkSession, tables: str, target: str, stamp: str, keep: int = 14, range_ids: int = RANGE_IDS) -> str:
    """Writes target/memory-<stamp>, with the rows of changed ranges only, and removes all but the newest keep snapshots; returns its path."""
    path, written, before = f"{target}/memory-{stamp}", f"{stamp}-{uuid.uuid4().hex}", _list(spark, target)
    now = stored(_digests(spark, tables, range_ids), "digests")
    last = manifest(spark, f"{target}/{before[-1]}") if before else spark.createDataFrame([], MANIFEST)
    full = stored(now.join(last, ["table", "range", "rows", "digest"], "left").withColumn("fresh", F.col("written").isNull()).fillna(written, "written"), "manifest")
    for name in DDL:
        fresh = full.where((F.col("table") == name) & F.col("fresh")).select("range")
        if fresh.isEmpty():
            continue
        rows = read_table(spark, tables, name)
        rows = gathered(rows.select("*", _range(rows, range_ids)), fresh)
        rows.write.partitionBy("range").mode("overwrite").option("compression", "zstd").parquet(f"{target}/parts/{name}/written={written}")
    full.drop("fresh").write.mode("overwrite").parquet(path)
    _forget(spark, target, [n for n in _list(spark, target)][:-keep])
    return path


def gathered(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """Of a table's rows(..., range) the fresh ranges, moved to few tasks each, unless few files hold a range, as where ids only grow."""
    spread = rows.select("range", F.input_file_name().alias("file")).distinct().groupBy("range").count().agg(F.max("count")).first()[0]
    kept = rows.join(fresh, "range", "left_semi")
    if (spread or 0) <= FILES_A_RANGE:
        return kept
    return kept.repartition("range", F.pmod(F.xxhash64(rows.columns[0]), F.lit(FILES_A_RANGE)))


def _forget(spark: SparkSession, target: str, names: list[str]) -> None:
    """Removes snapshots, and the ranges that no other one names."""
    if not names:
        return
    rest = [n for n in _list(spark, target) if n not in names]
    parts = lambda which: reduce(DataFrame.unionByName, (manifest(spark, f"{target}/{n}") for n in which)).select("table", "range", "written").distinct()
    useless = stored(parts(names).join(parts(rest), ["table", "range", "written"], "left_anti") if rest else parts(names), "useless")
    for n in names:  # manifests first: a snapshot that is there is whole
        fs, p = _path(spark, f"{target}/{n}")
        fs.delete(p, True)
    for r in useless.toLocalIterator():  # a row a range
        fs, p = _path(spark, f"{target}/parts/{r['table']}/written={r['written']}/range={r['range']}")
        fs.delete(p, True)


def read_snapshot(spark: SparkSession, snapshot: str, name: str) -> DataFrame:
    """The rows of a table in a snapshot: of the backups that wrote some of them, the ranges that the manifest names."""
    named = manifest(spark, snapshot).where(F.col("table") == name).select("range", "written")
    root = f"{snapshot.rstrip('/').rpartition('/')[0]}/parts/{name}"
    backups = [r["written"] for r in named.select("written").distinct().collect()]  # at most as many as backups
    if not backups:
        return spark.createDataFrame([], DDL[name])
    rows = spark.read.schema(f"{DDL[name]}, range long, written string").option("basePath", root).parquet(*(f"{root}/written={b}" for b in backups))
    return rows.join(named, ["written", "range"], "left_semi").drop("written", "range")


def restore(spark: SparkSession, snapshot: str, tables: str) -> None:
    """Writes the tables of a snapshot to a folder that has none."""
    for name in DDL:
        read_snapshot(spark, snapshot, name).write.mode("error").parquet(f"{tables}/{name}")


def changed_since(spark: SparkSession, tables: str, snapshot: str, range_ids: int = RANGE_IDS) -> bool:
    """Whether a table has other rows than in a snapshot of ranges of range_ids: the tables are read once, of the snapshot the manifest only."""
    now, then = _digests(spark, tables, range_ids), manifest(spark, snapshot).select("table", "range", "rows", "digest")
    return not now.withColumn("side", F.lit(1)).unionByName(then.withColumn("side", F.lit(-1))).groupBy("table", "range", "rows", "digest").agg(F.sum("side").alias("n")).where("n <> 0").isEmpty()


def tick(spark: SparkSession, tables: str, target: str, stamp: str, keep: int = 14, range_ids: int = RANGE_IDS) -> str | None:
    """A timer's turn: a backup if there is none yet or a row has changed since the newest one; its path, or None."""
    before = _list(spark, target)
    if before and not changed_since(spark, tables, f"{target}/{before[-1]}", range_ids):
        return None
    return backup(spark, tables, target, stamp, keep, range_ids)
