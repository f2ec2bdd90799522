"""Toxicity: held-out ranking, labels and columns that must not matter, awkward rows."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from helpers import AWKWARD, documents
from pyspark.sql import functions as F

from recallgrid.llm import queries, toxicity


def ranking(pairs):
    """Share of (toxic, clean) pairs in the right order."""
    toxic, clean = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in queries.op10_toxicity(spark, sf_dir).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in out.values())
    assert ranking([(out[i]["score"], y) for i, y in labels.items() if y is not None and i in out and out[i]["held_out"]]) > 0.93


def test_only_texts_are_scored(spark):
    words = ["good day to all", "you vile wretch"]
    rows = [(k, f"{words[k % 2]} number {k}") for k in range(60)]
    train = documents(spark, rows).select("doc_id", "text", (F.col("doc_id") % 2).cast("int").alias("label"))
    model = toxicity.train(train)
    seen = lambda df: {r["doc_id"]: round(r["score"], 9) for r in toxicity.score(df, model).collect()}
    odd = documents(spark, [(i, t, None, "elsewhere") for i, t in rows], extra=True)
    assert seen(odd) == seen(documents(spark, rows))
    assert ranking([(s, i % 2) for i, s in seen(odd).items()]) == 1.0
    again = toxicity.train(train.repartition(5))
    assert max(abs(model["weights"] - again["weights"])) < 1e-6


def test_awkward_rows(spark):
    train = documents(spark, AWKWARD).select("doc_id", "text", (F.col("doc_id") % 2).cast("int").alias("label"))
    docs = documents(spark, AWKWARD + [(None, "x"), (1, None)], extra=True)
    out = toxicity.score(docs, toxicity.train(train)).collect()
    assert len(out) == len(AWKWARD) + 2
    assert all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (1, 2, 13)}) == 1
    for rows, share in ((train.where("false"), 0.5), (train.where("label = 1"), 1.0), (train.where("label = 0"), 0.0)):
        assert {r["score"] for r in toxicity.score(docs, toxicity.train(rows)).collect()} == {share}
    assert toxicity.score(docs.where("false"), toxicity.train(train)).count() == 0


def test_sample_is_bounded(spark):
    labels = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    assert toxicity.sample(labels, 10).count() == 10
    assert toxicity.train(documents(spark, [(k, f"t{k}") for k in range(40)]).select("doc_id", "text", (F.col("doc_id") % 2).cast("int").alias("label")), max_rows=8)["weights"] is not None


def grams(text):
    """Buckets of the character n-grams of a text, one n-gram after another."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    out = set()
    for n in toxicity.SIZES:
        for k in range(len(low) - n + 1):
            points, at = toxicity.characters(np.frombuffer(low[k : k + n].encode(), dtype=np.uint8), np.array([0, len(low[k : k + n].encode())]))
            out.add(int(list(toxicity._buckets(points, at))[toxicity.SIZES.index(n)][0]))
    return out


def test_ratios_fit_and_scores_by_hand(spark):
    """Log-count ratios of either sign, the loss at its minimum, and scores, all from plain counts. Letters beyond ASCII are one character."""
    rows = [(k, ("schöner Tag für " if k % 2 else "übler Wicht, ") + f"Nummer {k}é", k % 2) for k in range(30)]
    model = toxicity.train(documents(spark, rows).select("doc_id", "text", (F.col("doc_id") % 2).cast("int").alias("label")), features=40)
    sets, kept = {k: grams(t) for k, t, _ in rows}, np.flatnonzero(model["index"][:-1] < len(model["weights"]))
    assert len(kept) == 40
    side = [sum(y == s for *_, y in rows) for s in (0, 1)]
    ratio = {}
    for b in set().union(*sets.values()):
        n = [sum(b in sets[k] for k, _, y in rows if y == s) for s in (0, 1)]
        r = math.log((n[1] + 1) / (side[1] + 2)) - math.log((n[0] + 1) / (side[0] + 2))
        ratio[b] = (r, abs(r) / math.sqrt(1 / (n[0] + 1) + 1 / (n[1] + 1)))
    assert {int(b) for b in kept} == set(sorted(ratio, key=lambda b: (-ratio[b][1], b))[:40])
    assert all(model["ratios"][model["index"][b]] == pytest.approx(ratio[b][0]) for b in kept)
    assert min(model["ratios"]) < 0 < max(model["ratios"])
    x = np.array([[model["ratios"][model["index"][b]] * (b in sets[k]) for b in kept] for k, *_ in rows])
    w = np.array([model["weights"][model["index"][b]] / model["ratios"][model["index"][b]] for b in kept])
    y = np.array([r[2] for r in rows])
    p = 1 / (1 + np.exp(-(x @ w + model["intercept"])))
    slope = x.T @ (p - y) / len(rows) + toxicity.PENALTY * w
    assert np.abs(slope).max() < 2e-3
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(documents(spark, [r[:2] for r in rows]), model).collect()}
    assert [scores[k] for k, *_ in rows] == pytest.approx(list(p), abs=1e-6)
