"""Exact dedup: SQL, composition of fingerprints, forced collisions, awkward rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from helpers import AWKWARD, documents, lowered
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import duckdb_rows, spark_rows
from recallgrid.llm import exact_dedup, queries


def test_same_rows_as_sql(spark, sf_dir):
    assert spark_rows(queries.op6_exact_dedup(spark, sf_dir)) == duckdb_rows(queries.OP6_SQL, sf_dir)


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.lists(st.integers(0, 300), max_size=4))
def test_parts_combine_to_the_whole(data, cuts):
    base, modulus, table = exact_dedup.BASES[0], exact_dedup.MODULI[0], {}
    x = np.frombuffer(data, dtype=np.uint8)
    at = sorted({0, len(x), *(min(c, len(x)) for c in cuts)})
    whole = (0, 1)
    for a, b in zip(at, at[1:], strict=False):
        whole = exact_dedup.combine(whole, exact_dedup.chunk_fingerprint(x[a:b], base, modulus, table), modulus)
    plain = 0
    for byte in data:
        plain = (plain * base + byte + 1) % modulus
    assert whole[0] == plain == exact_dedup.fingerprint(x, base, modulus, table)


ROWS = [r for r in AWKWARD] + [(None, "same"), (None, "SAME"), (20, "same"), (21, "z"), (21, "z"), (30, "Ä"), (31, "ä")]


@pytest.mark.parametrize("options", [{}, {"moduli": (3, 2)}, {"parallel_bytes": 1000}])
def test_groups(spark, options):
    """Also where nearly all fingerprints collide, and where long texts are hashed in parts."""
    docs = documents(spark, ROWS, extra=True)
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(lowered(t), []).append(i)
    out = exact_dedup.exact_duplicates(docs, **options).collect()
    assert len(out) == len(ROWS)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in out:
        ids = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in out) == len(groups)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in out if r["doc_id"] not in (21, None))


def test_deduplicate(spark):
    docs = documents(spark, ROWS + [(None, "lone"), (None, "lone"), (50, "half"), (50, "other half"), (60, "same"), (60, "kept beside it")], extra=True)
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    kept = sorted((lowered(r["text"]), r["doc_id"]) for r in out.where("doc_id is not null").collect())
    want = {}
    for i, t, *_ in ROWS + [(50, "half"), (50, "other half"), (60, "same"), (60, "kept beside it")]:
        want[lowered(t)] = max(want.get(lowered(t), -1), i or -1)
    assert kept == sorted(want.items())
    assert out.where("doc_id is null").count() == 1
    assert exact_dedup.deduplicate(docs.where("false")).count() == 0


def test_hot_group_is_dealt_out(spark, monkeypatch):
    """Copies beyond what one task compares, among them a text that only the comparison tells apart."""
    monkeypatch.setattr(exact_dedup, "COPIES_PER_TASK", 10)
    rows = [(k, "hot text") for k in range(300)] + [(300 + k, "hot texs") for k in range(5)]
    out = exact_dedup.exact_duplicates(documents(spark, rows).repartition(4), moduli=(1, 1)).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in out} == {(k, 299, 300) for k in range(300)} | {(300 + k, 304, 5) for k in range(5)}
    assert sum(r["kept"] for r in out) == 2
