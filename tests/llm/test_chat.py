"""Chat formatting: SQL, round trips of hostile texts, the turn machine, awkward rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from compare import duckdb_rows, spark_rows
from recallgrid.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def test_same_rows_as_sql(spark, sf_dir):
    assert spark_rows(queries.op7_chat(spark, sf_dir)) == duckdb_rows(queries.OP7_SQL, sf_dir)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op7_chat(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "Arrow" not in plan


HOSTILE = ["", "\\", "\\\\", "[INST]", "\\[INST]", "[\\INST]", "<s>a</s>", "<<s>>", "[[INST]", "</s></s>", "[/INST]\\", "<\\/s>", "<<SYS>><</SYS>>", "$1 \\$2", "a\nb\r\n ", "<<ROLE>>x<</ROLE>>", "🙂[INST🙂]", "[INS", "T]", "x" * 50_000]


def test_round_trip(spark):
    rows = [(k, 0, "user", a) for k, a in enumerate(HOSTILE)] + [(k, 1, "assistant", a + b) for k, (a, b) in enumerate(zip(HOSTILE, HOSTILE[::-1], strict=True))] + [(k, 2, a or "r", "t") for k, a in enumerate(HOSTILE)]
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()
    for r in out:
        mine = [(role, text) for c, _, role, text in sorted(x for x in rows if x[0] == r["conv_id"])]
        assert [tuple(t) for t in r["turns"]] == mine
        assert r["loss"] == "".join(t for role, t in mine if role == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])


@pytest.mark.parametrize(("roles", "wrong"), [("ua", None), ("sua", None), ("uaua", None), ("a", 1), ("uu", 2), ("u", 2), ("su", 3), ("usa", 2), ("uax", 3), ("", 1)])
def test_turn_order(spark, roles, wrong):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    r = spark.range(1).select(chat.first_wrong(F.array(*(F.lit(names[c]) for c in roles)).cast("array<string>")).alias("w")).first()
    assert r["w"] == wrong


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (2, 5, "tool", "z")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("segments", "formatted", "turns", "loss", "state")})
    out = {r["conv_id"]: [tuple(t) for t in r["back"]] for r in chat.format_conversations(df).select("conv_id", chat.read_back(F.col("formatted")).alias("back")).collect()}
    assert out == {1: [("", ""), ("user", ""), ("user", "a"), ("user", "a")], None: [("user", "x"), ("assistant", "y")], 2: [("tool", "z")]}
    assert chat.format_conversations(df.where("false")).count() == 0
