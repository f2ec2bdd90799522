"""What is moved and how often tables are read, as seen in plans and by counting rows."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import functions as F

from recallgrid import fixtures
from recallgrid.operators import episodes, facts, recall


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_facts_without_vectors_are_a_scan(spark, sf_dir):
    plan = optimized(fixtures.view(spark, sf_dir, "v_facts").select("id", "content", "content_hash"))
    assert "Join" not in plan and "sha2(" in plan


def test_hashes_are_made_before_vectors_are_met(spark, sf_dir):
    plan = optimized(fixtures.view(spark, sf_dir, "v_facts").select("id", "content_hash", "embedding"))
    assert plan.count("Join") == 1 and plan.index("Join") < plan.index("sha2(")


def counted(spark, n):
    """n facts of like vectors, whose rows are counted each time that they are made."""
    made = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            made.add(len(f))
            yield f

    rows = [(i, "some words", f"h{i}", [1.0, i * 1e-4], 1e9, 1e9, None, None, None) for i in range(1, n)] + [(n, "some other words", "x", [0.0, 1.0], 1e9, 1e9, None, None, None)]
    schema = "id long, content string, content_hash string, embedding array<float>, event_date double, created_at double, invalidated_at double, quarantined_at double, importance int"
    return spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype(object).values.tolist(), schema).mapInPandas(run, schema), made


def test_longer_prefixes_do_not_read_the_facts_again(spark):
    rows, made = counted(spark, 60)
    states = {r["id"]: r["state"] for r in recall.trace(rows, "words", [1.0, 0.0], 1e9, 2).collect()}
    assert made.value == 60
    assert [states[i] for i in (1, 2, 59, 60)] == ["kept", "collapsed", "collapsed", "kept"]
    found, made = counted(spark, 60)
    assert [r["id"] for r in recall.recall(found, "words", [1.0, 0.0], 1e9, 2).collect()] == [1, 60]
    assert made.value == 180  # scores once; the texts of what was found twice, as the sort looks at its rows first
    assert recall.duplicate_edges(rows, "words", [1.0, 0.0], 1e9, 2).where(F.col("a") == F.col("b")).isEmpty()


def test_like_takes_time_in_proportion_to_a_text(spark):
    """Wildcards as ilike reads them, and a long text that has the first pieces everywhere and the last nowhere."""
    said = ["", "TaO then X", "t\no\nx", "x t-o", "to x", "tÄox", "T%O_x", "t.o x", None, "atboc", "aTo\U0001f600x", "A.B", "a+b", "tx ox", "o_x t_o x"]
    df = spark.createDataFrame([(s,) for s in said], "s string")
    for query in ("t_o%x", "t%o", "%x", "_", "a.b", "A+_", "t__o", "o_x", "%%", "__%Ä%X", "", "b\\_x", "to%_"):
        rows = df.select(facts.like(F.col("s"), query).alias("a"), F.col("s").ilike(f"%{query}%").alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows], query
    long = spark.range(1).select(F.repeat(F.lit("tao "), 200_000).alias("s"))
    began = time.perf_counter()
    assert long.where(facts.like(F.col("s"), "t_o%x")).isEmpty()
    assert time.perf_counter() - began < 20  # minutes, going back


def test_lengths_of_files_need_no_texts(spark, sf_dir):
    """What a window counts of a message's files is summed where they lie; bodies are gathered only if asked for."""
    v = lambda name: fixtures.view(spark, sf_dir, name)
    bodies = episodes.with_bodies(v("v_messages"), episodes.attachments_by_message(v("v_attachments"), v("v_captions")))
    sizes = bodies.select("conversation_id", "id", "view_len")
    assert "collect_list" not in optimized(sizes) and "collect_list" in optimized(bodies)
    other = episodes.with_bodies(v("v_messages"), episodes.attachments_by_message(v("v_attachments"), v("v_captions")).drop("chars")).select("conversation_id", "id", "view_len")
    assert sorted(map(tuple, sizes.collect())) == sorted(map(tuple, other.collect()))


def test_texts_of_attachments_do_not_move_to_meet_conversations(spark, sf_dir):
    """Digests are made below the join, and the few ids of conversations are sent to the texts, as their size is known."""
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "4096")  # the conversations are larger, their ids aren't
    try:
        files = fixtures.view(spark, sf_dir, "v_attachments")
        plan = optimized(files.select("id", "sha256"))
        assert plan.count("Join") == 1 and plan.index("Join") < plan.index("sha2(")
        plan = files.select("id", "extracted_text")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set(key, before)


def test_texts_of_facts_do_not_move_to_meet_the_pools(spark, sf_dir):
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "16384")  # the facts are larger, what the pools name isn't
    try:
        rows = recall.pools(fixtures.view(spark, sf_dir, "v_facts"), fixtures.NOW)
        plan = rows.select("pool", "id", "content")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set(key, before)
