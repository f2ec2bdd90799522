"""A summary whose entries don't fit into one prompt."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from recallgrid.operators import summary
from recallgrid.operators.facts import numbered

SIZES = [5, 900, 3, 3, 2500, 1, 40, 40, 999, 0, 7]


def rows(spark, sizes):
    return spark.createDataFrame([(k, "x" * n) for k, n in enumerate(sizes)], "place long, text string")


def test_blocks_are_consecutive_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(summary, "STRETCH", 3)
    for sizes in (SIZES, [10] * 60, [3000] * 7, [3000] * 5 + [1] * 40, [1] * 40 + [3000] * 5, [4]):
        blocks = [r["text"] for r in summary.packed(rows(spark, sizes), 1000).orderBy("block").collect()]
        assert "\n".join(blocks) == "\n".join("x" * n for n in sizes)
        assert len(blocks) <= (len(sizes) + 1) // 2
        for b in blocks:
            parts = b.split("\n")
            assert len(parts) <= 2 or sum(len(x) + 1 for x in parts[:-1]) <= 1000


def test_every_line_is_asked_once_at_each_level(spark):
    lines = spark.range(700).select((F.col("id") % 7).cast("double").alias("day"), "id", F.concat(F.lit("#"), F.col("id").cast("string"), F.lit("." * 40)).alias("text"))
    want = [f"#{k}" for day in range(7) for k in range(day, 700, 7)]
    said = summary.reduced(lines, 4000, lambda part: " ".join(re.findall(r"#\d+", part)))
    assert re.findall(r"#\d+", said) == want and len(said) <= 4000
    assert summary.reduced(lines, 100_000, lambda part: 1 / 0).count("\n") == 699
    assert summary.reduced(lines, 4000, lambda part: "") == ""
    assert len(summary.reduced(lines, 4000, lambda part: "long " * 2000)) == 10_000  # a model that never shortens still comes to an end
    assert summary.reduced(lines.where("false"), 10, lambda part: "") == ""


def test_numbers_have_no_gaps(spark):
    assert sorted(r["id"] for r in numbered(spark.range(50).select((F.col("id") % 3).alias("day"), "id"), ["day", "id"], 0).collect()) == list(range(50))


def test_the_driver_holds_one_prompt(spark, sf_dir):
    from recallgrid import fixtures

    facts, prompts = fixtures.view(spark, sf_dir, "v_facts"), []
    notes = lambda part: " ".join(sorted(set(re.findall(r"\[(\d+) ·", part)) | set(re.findall(r"<(\d+)>", part)), key=int))

    class Model:
        """Names what it was asked about; keeps what the driver asked."""

        def __call__(self, prompt: str) -> str:
            if prompt.startswith(summary.NOTES):
                return " ".join(f"<{i}>" for i in notes(prompt).split())
            prompts.append(prompt)
            return "profile"

        def __reduce__(self):
            return (Model, ())

    content, named = summary.drafted(facts, fixtures.NOW, 800, Model(), window=12_000)
    ids = {r["id"] for r in named.collect()}
    assert content == "profile" and len(prompts) == 1 and len(prompts[0]) < 12_200
    assert {int(i) for i in notes(prompts[0]).split()} == ids and len(ids) > 100
    assert {r["id"] for r in summary.sources(facts, fixtures.NOW).collect()} == ids
    made = summary.regenerate(facts, fixtures.NOW, 800, lambda prompt: "profile", window=12_000)
    assert set(made["source_fact_ids"]) == ids and len(made["source_fact_ids"]) == len(ids)
