"""Snapshots that share the ranges they have in common."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from recallgrid.schema import DDL
from recallgrid.sources import readers, snapshots


def fact_rows(spark, lo, hi):
    schema = spark.createDataFrame([], DDL["facts"]).schema
    given = {"id": F.col("id"), "content": F.concat(F.lit("c"), F.col("id")), "embedding": F.array(F.lit(0.5), F.lit(None)).cast("array<float>")}
    return spark.range(lo, hi).select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


@pytest.fixture
def ledger(spark, tmp_path):
    tables = str(tmp_path / "tables")
    readers.create_tables(spark, tables)
    fact_rows(spark, 0, 50).write.mode("append").parquet(f"{tables}/facts")
    spark.createDataFrame([("k", "v"), (None, "w")], DDL["settings"]).write.mode("append").parquet(f"{tables}/settings")
    return tables, str(tmp_path / "backups")


def ranges(spark, snapshot):
    return {r["range"]: (r["rows"], r["written"]) for r in snapshots.manifest(spark, snapshot).where("table = 'facts'").collect()}


def equal(spark, a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_one_changed_fact_rewrites_one_range(spark, ledger, tmp_path):
    tables, target = ledger
    first = snapshots.tick(spark, tables, target, "20240101-000000", range_ids=10)
    assert snapshots.tick(spark, tables, target, "20240102-000000", range_ids=10) is None
    before = {n: readers.read_table(spark, tables, n).collect() for n in ("facts", "settings")}
    readers.read_table(spark, tables, "facts").withColumn("importance", F.when(F.col("id") == 33, 9).otherwise(F.col("importance"))).repartition(3).write.parquet(f"{tables}/facts2")
    spark.read.schema(DDL["facts"]).parquet(f"{tables}/facts2").write.mode("overwrite").parquet(f"{tables}/facts")
    second = snapshots.tick(spark, tables, target, "20240103-000000", range_ids=10)
    one, two = ranges(spark, first), ranges(spark, second)
    assert [k for k in two if one[k] != two[k]] == [3] and set(one) == set(two) == set(range(5))
    for name, rows in before.items():
        assert equal(spark, snapshots.read_snapshot(spark, first, name), spark.createDataFrame(rows, DDL[name]))
    snapshots.restore(spark, second, str(tmp_path / "again"))
    for name in DDL:
        assert equal(spark, readers.read_table(spark, str(tmp_path / "again"), name), readers.read_table(spark, tables, name))


def test_ranges_of_removed_snapshots_go_unless_another_names_them(spark, ledger):
    tables, target = ledger
    snapshots.backup(spark, tables, target, "20240101-000000", range_ids=10)
    fact_rows(spark, 49, 60).write.mode("append").parquet(f"{tables}/facts")  # 49 again: a repeat counts
    last = snapshots.backup(spark, tables, target, "20240102-000000", keep=1, range_ids=10)
    assert snapshots._list(spark, target) == ["memory-20240102-000000"]
    assert {k: n for k, (n, _) in ranges(spark, last).items()} == {0: 10, 1: 10, 2: 10, 3: 10, 4: 11, 5: 10}
    assert equal(spark, snapshots.read_snapshot(spark, last, "facts"), readers.read_table(spark, tables, "facts"))
    assert spark.read.parquet(f"{target}/parts/facts").groupBy("written", "range").count().count() == 6


def test_what_a_killed_backup_left_is_in_no_snapshot(spark, ledger):
    tables, target = ledger
    first = snapshots.backup(spark, tables, target, "20240101-000000", range_ids=10)
    fact_rows(spark, 0, 5).withColumn("range", F.lit(0)).write.partitionBy("range").parquet(f"{target}/parts/facts/written=20240102-dead")
    assert snapshots.read_snapshot(spark, first, "facts").count() == 50
    assert not snapshots.changed_since(spark, tables, first, 10)
    spark.createDataFrame([("k", "v")], DDL["settings"]).write.mode("append").parquet(f"{tables}/settings")
    assert snapshots.changed_since(spark, tables, first, 10)  # a repeated row is a change


def test_ranges_that_few_files_hold_are_not_moved(spark, tmp_path):
    rows = spark.range(400).withColumn("range", F.floor(F.col("id") / 40))
    rows.repartitionByRange(4, "id").write.parquet(str(tmp_path / "near"))
    rows.repartition(20, F.col("id") % 20).write.parquet(str(tmp_path / "strewn"))
    for name, moved in (("near", False), ("strewn", True)):
        got = snapshots.gathered(spark.read.parquet(str(tmp_path / name)), rows.where("range < 9").select("range").distinct())
        assert ("RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString()) == moved
        assert sorted(r["id"] for r in got.collect()) == list(range(360))
