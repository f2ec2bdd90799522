"""Near duplicates: all pairs by brute force, sketch properties, crowded groups, awkward rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import AWKWARD, components, documents, shingles

from recallgrid.llm import minhash, queries
from recallgrid.llm.arrays import mix


def check(docs, rows, percent):
    out = {r["doc_id"]: r for r in minhash.near_duplicates(docs, percent).collect()}
    want = components(rows, percent)
    assert {i: r["component_id"] for i, r in out.items()} == want
    assert {i: r["n_shingles"] for i, r in out.items()} == {i: len(shingles(t)) for i, t in rows}
    assert all(r["kept"] == (i == want[i]) for i, r in out.items())


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(docs, rows, 80)
    assert {r["doc_id"]: r["component_id"] for r in queries.op9_minhash(spark, sf_dir).collect()} == components(rows, 85)


def family(rng, n, words, edits, first=0):
    """Edited copies of one text: chains, so that members differ more from each other than from a neighbour."""
    text = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for k in range(n):
        out.append((first + k, " ".join(text)))
        for _ in range(edits):
            text[rng.randrange(words)] = f"v{rng.randrange(10_000)}"
    return out


@pytest.mark.parametrize("few", [minhash.FEW, 0])
def test_chains(spark, monkeypatch, few):
    """Links by way of others; also with every crowded bucket compared in blocks."""
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(5)
    rows = family(rng, 60, 120, 1) + family(rng, 40, 60, 1, 100) + family(rng, 20, 200, 2, 200) + [(300 + k, f"alone {k} " * 9) for k in range(20)]
    rng.shuffle(rows)
    check(documents(spark, rows), rows, 80)


def test_many_copies(spark):
    rows = [(k, "the very same text of some more words") for k in range(400)] + [(500 + k, f"the very same text of some more words and {k}") for k in range(40)]
    check(documents(spark, rows), rows, 80)


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD, extra=True)
    check(docs, AWKWARD, 85)
    odd = documents(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "p q r s t u")], extra=True)
    out = minhash.near_duplicates(odd).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in out) == [(0, None, True), (0, None, True), (7, 7, True), (7, 7, True), (9, 9, True)]
    kept = minhash.drop_near_duplicates(docs, 80)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(components(AWKWARD, 80).values()))
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    apart = []
    for size, shared in ((1, 1), (5, 4), (50, 40), (400, 320)):
        for _ in range(20):
            x = mix(rng.integers(0, 1 << 63, 2 * size - shared, dtype=np.uint64))
            a, b = x[:size], x[size - shared :]
            s = minhash.sketch(np.concatenate([a, b]), np.array([0, size, 2 * size]))
            assert (s != minhash.FULL).all()
            apart.append(abs((s[0] == s[1]).mean() - shared / (2 * size - shared)))
    assert np.mean(apart) < 0.03
