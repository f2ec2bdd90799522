"""Fingerprints: merging, containment, estimates against full shingle sets, awkward rows."""

from __future__ import annotations

import hashlib
import random

import pytest
from helpers import AWKWARD, documents, shingles
from pyspark.sql import functions as F

from recallgrid.llm import fingerprints, queries


def edited(rows):
    """Each text with its last quarter replaced from the next one."""
    rows = sorted(rows, key=lambda r: r[0])
    texts = [t or "" for _, t in rows]
    return {i: t[: len(t) - len(t) // 4] + texts[(k + 1) % len(rows)][: len(t) // 4] for k, (i, t) in enumerate(zip([i for i, _ in rows], texts, strict=True))}


def true_likeness(a, b):
    x, y = shingles(a), shingles(b)
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts, want = dict(docs), edited(docs)
    out = queries.op4_fingerprints(spark, sf_dir).collect()
    assert len(out) == len(docs)
    apart, by_text = [], {}
    order = sorted(texts)
    following = {i: texts[order[(k + 1) % len(order)]] for k, i in enumerate(order)}
    for r in out:
        t = texts[r["doc_id"]] or ""
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        assert abs(r["near_next"] - true_likeness(t, following[r["doc_id"]])) < 0.2 or len(shingles(t)) < 60
        apart.append(abs(r["near_edited"] - true_likeness(t, want[r["doc_id"]])))
    assert sum(apart) / len(apart) < 0.07


def test_all_hashes_kept_is_exact(spark):
    rows = [(1, "a b c d e f g"), (2, "b c d e f g h"), (3, "A B C D E F G")]
    out = {r["doc_id"]: r for r in fingerprints.fingerprints(documents(spark, rows), fraction=1.0).withColumn("l", fingerprints.likeness(F.col("own_sketch"), F.col("next_sketch"))).withColumn("c", fingerprints.containment(F.col("own_sketch"), F.col("next_sketch"))).collect()}
    assert out[1]["l"] == pytest.approx(2 / 4)
    assert out[1]["c"] == pytest.approx(2 / 3)
    assert out[3]["l"] == 1.0
    assert out[1]["own_sketch"] == out[3]["own_sketch"]


@pytest.mark.parametrize("fraction", [0.02, 0.25, 0.9])
def test_merged_parts_are_the_whole(spark, fraction):
    """Parts cut between their shingles: merging their sketches gives the sketch of all shingles, in any order."""
    rng = random.Random(7)
    lists = [[" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 4))] for _ in range(60)]
    make = lambda c: fingerprints.sketch(c, fraction, width=99)  # noqa: E731  each text is one shingle
    all_ = F.aggregate(F.transform("parts", make), F.array().cast("array<bigint>"), lambda a, x: fingerprints.merged(a, x, fraction))
    back = F.aggregate(F.transform(F.reverse("parts"), make), F.array().cast("array<bigint>"), lambda a, x: fingerprints.merged(x, a, fraction))
    limit = -(1 << 63) + int(fraction * (1 << 64)) - 1
    every = F.transform("parts", lambda t: F.get(fingerprints.sketch(t, 1.0, width=99), 0))
    for r in spark.createDataFrame([(x,) for x in lists], "parts array<string>").select(all_.alias("a"), back.alias("b"), every.alias("e")).collect():
        low = sorted({h for h in r["e"] if h <= limit}) or [min(r["e"])]
        assert r["a"] == r["b"] == low


def test_containment_of_a_lone_hash_is_unknown(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    c = lambda a, b: fingerprints.containment(F.array(*map(F.lit, a)).cast("array<bigint>"), F.array(*map(F.lit, b)).cast("array<bigint>"))
    r = spark.range(1).select(c([high], [low]), c([high], [high]), c([low], [high]), c([], [low]), c([low], [low, low + 1])).first()
    assert tuple(r) == (None, 1.0, 0.0, 1.0, 1.0)


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD, extra=True)
    out = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    assert {i: r["edited"] for i, r in out.items()} == edited(AWKWARD)
    assert out[1]["own_sketch"] == out[2]["own_sketch"] == out[3]["own_sketch"] == []
    assert out[4]["own_sketch"] == out[5]["own_sketch"]
    assert out[6]["own_sketch"] == out[7]["own_sketch"] == out[8]["own_sketch"]
    assert len(out[9]["own_sketch"]) == 1
    assert out[14]["next_text"] == ""
    odd = fingerprints.fingerprints(documents(spark, [(None, "b"), (None, "a"), (1, "c"), (1, "c")])).collect()
    assert sorted((r["text"], r["next_text"]) for r in odd) == [("a", "b"), ("b", "c"), ("c", "a"), ("c", "c")]
    assert fingerprints.fingerprints(docs.where("false")).count() == 0
    assert fingerprints.fingerprints(documents(spark, [(5, "alone")])).first()["next_text"] == "alone"
