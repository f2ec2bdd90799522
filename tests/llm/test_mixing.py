"""Mixing: targets, totals and caps against plain arithmetic, awkward rows."""

from __future__ import annotations

import math

import pytest
from helpers import AWKWARD, documents, word_list
from pyspark.sql import functions as F

from recallgrid.llm import mixing, queries


def targets(sizes: dict, share: float, cap: float) -> dict:
    """Water filling, one source after another."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: queries.MIX_WEIGHTS[k % 3] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def check(rows, texts):
    sizes, taken = {}, {}
    for r in rows:
        s = r["source"]
        assert r["size"] == len(word_list(texts[r["doc_id"]]))
        assert r["taken"] <= 2 * r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    want = targets(sizes, 1.5, 2)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        # whole copies: a source is off by half of a text that outweighs all the others at most
        largest = max(r["size"] for r in rows if r["source"] == s)
        assert abs(taken[s] - want[s]) <= max(20, 0.02 * want[s], largest / 2 if largest > sizes[s] / 2 else 0), s


def check_rates(rows):
    """Rates against the dual of each source solved on its own by bisection."""
    for s in {r["source"] for r in rows}:
        mine = [r for r in rows if r["source"] == s]
        mean, target = sum(r["size"] for r in mine) / len(mine), mine[0]["target"]
        rate = lambda m, size: min(2.0, math.exp(min(700.0, m * size / mean)))  # noqa: B023, E731
        low, high = -200.0, 200.0
        for _ in range(200):
            m = (low + high) / 2
            low, high = (m, high) if sum(rate(m, r["size"]) * r["size"] for r in mine) < target else (low, m)
        full = target >= 2 * sum(r["size"] for r in mine) * (1 - 1e-12)
        assert all(r["rate"] == pytest.approx(2.0 if full else rate(low, r["size"]), abs=1e-5) for r in mine)
        assert full or len({round(r["rate"], 6) for r in mine}) > 5


def test_documents(spark, sf_dir):
    rows = queries.op3_mixing(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    check(rows, texts)
    check_rates(rows)
    again = queries.op3_mixing(spark, sf_dir).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}


def test_awkward_rows(spark):
    rows = AWKWARD + [(100 + k, "some words here " * (k % 7), "en", [None, "", "hot", "hot", "hot", "b"][k % 6]) for k in range(200)]
    docs = documents(spark, rows, extra=True)
    out = mixing.mix(docs, queries.MIX_WEIGHTS).withColumn("taken", F.col("copies") * F.col("size")).collect()
    assert len(out) == len(rows)
    check(out, {r[0]: r[1] for r in rows})
    assert mixing.mix(docs.where("false"), [1.0]).count() == 0
    blank = mixing.mix(documents(spark, [(1, None), (2, " ")]), [1.0]).collect()
    assert {(r["target"], r["copies"]) for r in blank} == {(0.0, 0)}


def test_mixed_rows_are_the_copies(spark):
    rows = [(k, f"w{k} " * (5 + k % 9), "en", "ab"[k % 2]) for k in range(60)] + [(None, "x y", "en", "a"), (7, "same", "en", "a"), (7, "same", "en", "a")]
    docs = documents(spark, rows, extra=True)
    plan = mixing.mix(docs, queries.MIX_WEIGHTS)
    out = mixing.mixed(docs, queries.MIX_WEIGHTS)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["n"] for r in out.where("doc_id <> 7").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {r["doc_id"]: r["copies"] for r in plan.where("doc_id <> 7 and copies > 0").collect()}
    taken = lambda df, copies: sorted((r["doc_id"] or -1, r["c"]) for r in df.groupBy("doc_id").agg(copies.cast("long").alias("c")).where("c > 0").collect())
    assert taken(out, F.count("*")) == taken(plan, F.sum("copies"))


def test_tilt_is_balanced_by_entropy(spark):
    """Rates are exp(multiplier * tilt) with one multiplier a source, and meet the target."""
    docs = documents(spark, [(k, "w " * (1 + k % 5), "en", "a") for k in range(400)])
    out = mixing.mix(docs, [1.0], share=1.2, cap=5, tilt=F.regexp_count("text", F.lit("w")) / 5.0).collect()
    multipliers = {round(math.log(r["rate"]) / (r["size"] / 5), 6) for r in out}
    assert len(multipliers) == 1
    assert sum(r["rate"] * r["size"] for r in out) == pytest.approx(out[0]["target"], rel=1e-6)


def test_rates_do_not_depend_on_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dealt = [docs.repartition(n, *by) for n, by in ((1, ()), (7, ("text",)), (13, ("doc_id",)))]
    first, *others = [sorted((r["doc_id"], r["rate"], r["copies"]) for r in mixing.mix(d, queries.MIX_WEIGHTS).collect()) for d in dealt]
    assert all(x == first for x in others)
