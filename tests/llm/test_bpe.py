"""BPE: ids and decoded texts against the tokenizers library, awkward rows."""

from __future__ import annotations

import hashlib

from helpers import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recallgrid.llm import bpe, queries, storage

PATH = queries.tokenizer("byte_bpe_50k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def check(docs, rows, block_bytes=1 << 20):
    t = library()
    out = bpe.decode(bpe.encode(docs, PATH, block_bytes), PATH).collect()
    assert len(out) == len(rows)
    want = sorted((i is None, i or 0, t.encode(x or "", add_special_tokens=False).ids, t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, x in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, list(r["ids"]), r["decoded"]) for r in out) == want


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = library()
    out = {r["doc_id"]: r for r in queries.op8_bpe(spark, sf_dir).collect()}
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        mine = out[r["doc_id"]]
        assert (mine["n_tokens"], mine["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert mine["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_awkward_rows(spark):
    rows = AWKWARD + [(None, "a b"), (None, "a b"), (4, "One two three"), (40, "  lead\t\ttabs \n\n\n end  "), (41, "\u0085 　x​ y᠎﻿"), (42, "१२३ ² ½ Ⅷ 'S 'll'VE"), (43, "é 👩‍👩‍👧 \U000e0041"), (44, "<|endoftext|>"), (45, "<|endoftext|><|endoftext|> x"), (46, "ab" * 5000)]
    check(documents(spark, rows, extra=True), rows)
    check(documents(spark, rows).repartition(3), rows, block_bytes=2000)
    assert bpe.encode(documents(spark, []).where("false"), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=120))
def test_long_words_merge_alike(word):
    ranks = bpe.load_vocabulary(PATH)["ranks"]
    test_long_words_merge_alike.ranks = ranks
    parts = [word[i : i + 1] for i in range(len(word))]
    assert bpe._merge_long(list(parts), ranks) == _plain(parts, ranks)


def _plain(parts, ranks):
    while len(parts) > 1:
        rank, at = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        parts = parts[:at] + [parts[at] + parts[at + 1]] + parts[at + 2 :]
    return parts


def test_decode_join(spark):
    coded = spark.createDataFrame([(1, [15496, 995]), (2, []), (3, None), (4, [50256, 8582])], "doc_id long, ids array<int>")
    t = library()
    out = {r["doc_id"]: r["decoded"] for r in bpe.decode(coded, PATH).collect()}
    assert out == {1: t.decode([15496, 995]), 2: "", 3: None, 4: t.decode([50256, 8582], skip_special_tokens=False)}


def test_decode_keeps_rows_and_columns(spark):
    """Lists over many Arrow batches, repeated rows, ids without a piece, other columns and clashing names."""
    t = library()
    long = t.encode("the same words again " * 9000).ids
    rows = [(1, long, "a", 1), (1, long, "a", 1), (2, [], None, 2), (None, None, "b", None), (3, [15496, None, 10**6, 995], "c", 3)] + [(k, [k], "d", k) for k in range(300, 340)]
    coded = spark.createDataFrame(rows, "doc_id long, ids array<int>, piece string, at int").coalesce(1)
    out = bpe.decode(coded.withColumn("decoded", F.lit("old")), PATH)
    assert out.columns == ["doc_id", "piece", "at", "ids", "decoded"]
    text = lambda ids: None if ids is None else t.decode([i for i in ids if i and i < 10**6], skip_special_tokens=False)
    want = [(i, p, a, ids, text(ids)) for i, ids, p, a in rows]
    assert [tuple(r) for r in out.collect()] == want
    assert bpe.decode(coded.where("false"), PATH).count() == 0


def test_several_special_tokens(spark):
    """Of tokens that begin at one place the longest counts."""
    t, special = library(), ["<a>", "<a><b>", "[x]"]
    t.add_special_tokens(special)
    rows = ["no token", "<a>", "x<a><b>y [x]z<a>", "<a><a><b>", "", "[x][x"]
    out = spark.createDataFrame([(r,) for r in rows], "text string").select("text", bpe.split_words(F.col("text"), special).alias("w")).collect()
    for r in out:
        assert "".join(r["w"]) == r["text"]
        assert [w for w in r["w"] if w in special] == [x for x in t.encode(r["text"], add_special_tokens=False).tokens if x in special]


def test_tables_are_removed(spark):
    before = {r["tableName"] for r in spark.sql("SHOW TABLES").collect()}
    with storage.scratch(spark):
        assert bpe.encode(documents(spark, AWKWARD), PATH).count() == len(AWKWARD)
    assert {r["tableName"] for r in spark.sql("SHOW TABLES").collect()} <= before
