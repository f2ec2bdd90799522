"""Importance resampling: checksums, whole runs against a plain version, the selection of the k-th key."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import duckdb_rows, spark_rows
from helpers import AWKWARD, LOWER, documents
from pyspark.sql import functions as F

from recallgrid.llm import queries, resampling


def runs(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), Counter(zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1))


def plain(docs, target):
    """doc_id, n_features, weight, score, rank of docs(doc_id, text)."""
    seen = [(i, *runs(t)) for i, t in docs]
    s, t = sum((c for *_, c in seen), Counter()), sum((runs(x)[1] for x in target), Counter())
    all_s, all_t = float(s.total() + 10_000), float(t.total() + 10_000)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    rows = []
    for i, n, c in seen:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(b) for b, n in c.items())
        rows.append((i, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return [(r[0], *r[2:], rank.get(id(r))) for r in rows]


def test_query(spark, sf_dir):
    assert spark_rows(queries.op13_resampling(spark, sf_dir)) == duckdb_rows(queries.oracle_sql()["op13_resampling"], sf_dir)


@pytest.mark.parametrize("piece", [7, 100, 1 << 22])
def test_checksums_of_runs(monkeypatch, piece):
    monkeypatch.setattr(resampling, "PIECE_BYTES", piece)
    rng = random.Random(piece)
    long = ["q" * n + " B " + "é" * 40 for n in (63, 64, 65, 129, 5000)]
    for texts in [["".join(rng.choice("abZ09 é.-\0") for _ in range(rng.choice([1, 8, 50, 400])))] for _ in range(60)] + [[t] for t in long] + [["", *long, "a b", None]]:
        got: dict[int, Counter] = {}
        for _, _, found in resampling._pieces(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])):
            for buckets, doc in found:
                for b, d in zip(buckets.tolist(), doc.tolist(), strict=True):
                    got.setdefault(d, Counter())[b] += 1
        assert [got.get(k, Counter()) for k in range(len(texts))] == [runs(t)[1] for t in texts]


def test_awkward_rows(spark):
    rng = random.Random(5)
    rows = AWKWARD + [(100 + i, " ".join(rng.choice("a b c de fg".split()) for _ in range(rng.randrange(15, 60)))) for i in range(150)] + [(None, "n " * 30)]
    rows += [rows[20], rows[20], (100, "another text of the same id " * 5)]
    target = ["a b c", None, "", "c de"]
    out = resampling.resample(documents(spark, rows, extra=True).withColumns({"tie": F.lit(1), "rank": F.lit("x")}), spark.createDataFrame([(t,) for t in target], "text string"))
    assert spark_rows(out)[1] == sorted(map(tuple, spark_rows(spark.createDataFrame(plain(rows, target), out.schema))[1]))
    empty = resampling.resample(documents(spark, []), spark.createDataFrame([], "text string"))
    assert empty.columns == ["doc_id", "n_features", "weight", "score", "rank"] and empty.count() == 0


def test_kth_key(spark):
    """Ties in the first and second key, keys of all sizes and signs, every k."""
    rng = random.Random(1)
    ends = [-(1 << 63), -1, 0, 1, (1 << 63) - 1]
    rows = [(rng.choice(ends[1:4]), rng.choice([*ends, rng.randrange(-(1 << 62), 1 << 62)]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "a long, b long, c long").repartition(3).cache()
    for k in (0, 1, 2, 17, 59, 60, 61):
        cond = resampling.up_to_kth(df, ["a", "b", "c"], k)
        got = df if cond is None else df.where(cond)
        assert sorted(tuple(r) for r in got.collect()) == sorted(rows)[:k]
    one = spark.createDataFrame([(5, 5, i) for i in range(5000)], "a long, b long, c long")
    assert one.where(resampling.up_to_kth(one, ["a", "b", "c"], 4321)).agg(F.max("c"), F.count("*")).first() == (4320, 4321)


def test_ranks_follow_the_order(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 2003 - 1000).alias("a"), "id")
    out = resampling.ranked(df, ["a", "id"]).collect()
    assert [r["rank"] for r in sorted(out, key=lambda r: (r["a"], r["id"]))] == list(range(1, 2001))
    assert np.unique([r["rank"] for r in out]).size == 2000
