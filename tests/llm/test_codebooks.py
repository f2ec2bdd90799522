"""Vector codes: kd-tree search, whole runs against plain ones, awkward rows, labels."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from compare import duckdb_rows, spark_rows
from pyspark.sql import functions as F

from recallgrid.llm import codebooks, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows):
    """vec_id, code, error of rows(vec_id, vector, label), and the codebooks, all entries compared."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    length = len(kept[0][1]) if kept else 0
    edges = [k * length // 4 for k in range(5)]
    cut = lambda v: [v[a:b] for a, b in zip(edges, edges[1:])]
    books = [[cut(v)[p] for _, v, _ in kept[:256]] for p in range(4)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(book))
    for _ in range(4):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(cut(v)[p], book)[1], []).append(cut(v)[p])
            for k, xs in groups.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v, label in kept:
        found = [nearest(cut(v)[p], books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    return out, hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(v) for c, v in more.items()})
    coded, books = codebooks.quantize(df)
    out = codebooks.with_label_errors(coded).collect()
    return out, codebooks.digest(books)


def test_query(spark, sf_dir):
    assert spark_rows(queries.op12_codes(spark, sf_dir)) == duckdb_rows(queries.oracle_sql()["op12_codes"], sf_dir)


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_tree_finds_the_lowest_nearest_index(spread):
    rng = np.random.default_rng(spread)
    for _ in range(40):
        points = rng.integers(-spread, spread + 1, (rng.integers(1, 300), rng.integers(1, 9)))
        x = rng.integers(-2 * spread, 2 * spread + 1, (200, points.shape[1]))
        d = ((x[:, None] - points[None]) ** 2).sum(axis=2)
        for kind in (np.float64, object):
            found, best = codebooks.KdTree(points.astype(kind)).nearest(x.astype(kind))
            assert (found == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_ties_repeats_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-3, 4) / 1024 for _ in range(9)], rng.choice([None, 0, 1])) for i in range(400)]
    rows += rows[:30] + [(7, rows[50][1], 1), (None, rows[51][1], None), (None, rows[52][1], 1)]
    rows += [(500, None, 0), (501, [], 0), (502, [None] * 9, 0), (503, [float("nan")] * 9, 0), (504, [0.0] * 8 + [float("inf")], 1), (505, [0.5] * 3, 1)]
    out, sha = run(spark, rows, code="own", error="own", grid="own", part=1)
    want, want_sha = plain(rows)
    assert sha == want_sha
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label"]) for r in out), key=key) == sorted(want, key=key)
    for r in out:
        assert r["label_error"] == sum(w[2] for w in want if w[3] == r["label"])


def test_large_components_are_exact(spark):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate([[40000.25, -39999.5, 1, 0], [40001, -40000, 0, 0], [0.0001, -0.0001, 3, 3]])]
    out, sha = run(spark, rows)
    want, want_sha = plain(rows)
    assert sha == want_sha and sorted((r["vec_id"], r["code"], r["error"]) for r in out) == [w[:3] for w in want]


def test_empty(spark):
    out, sha = run(spark, [])
    assert out == [] and sha == hashlib.sha256(b"").hexdigest()
    assert run(spark, [(1, None, 1), (2, [], 2)])[0] == []


def test_equal_vectors_everywhere(spark):
    """One vector holds all rows: only the first of its entries is used, the others stay."""
    rows = [(i, [0.25] * 8, i % 2) for i in range(600)]
    out, sha = run(spark, rows)
    assert sha == plain(rows)[1] and {(r["code"], r["error"], r["label_error"]) for r in out} == {("00000000", 0, 0)}
