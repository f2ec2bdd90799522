"""The pipeline over whole documents, each stage held against a plain version."""

from __future__ import annotations

import hashlib
from pathlib import Path

from helpers import AWKWARD, components, documents, lowered, word_list
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from recallgrid.llm import queries
from recallgrid.llm.storage import stored
from test_mixing import targets


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "exact dedup", "MinHash near-dedup", "mixing", "BPE"]
    known = stored(stages["language ID"](spark, docs, sf_dir), "test")
    assert known.columns == docs.columns
    truth = {r["doc_id"]: r for r in docs.collect()}
    rows = known.collect()
    assert sum(r["lang"] == truth[r["doc_id"]]["lang"] for r in rows) / len(rows) > 0.97
    assert len(rows) > 0.9 * sum(len(word_list(r["text"])) > 20 for r in truth.values())

    one = stored(stages["exact dedup"](spark, known, sf_dir), "test")
    best = {}
    for r in rows:
        best[lowered(r["text"])] = max(best.get(lowered(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(best.values())

    apart = stored(stages["MinHash near-dedup"](spark, one, sf_dir), "test")
    assert {r["doc_id"] for r in apart.collect()} == set(components([(r["doc_id"], r["text"]) for r in one.collect()], 80).values())

    mixed = stored(stages["mixing"](spark, apart, sf_dir), "test")
    assert mixed.columns == docs.columns
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    sizes, taken = ({r["source"]: r["n"] for r in d.groupBy("source").agg(F.sum(size).alias("n")).collect()} for d in (apart, mixed))
    want = targets(sizes, 1.5, 2)
    assert all(abs(taken.get(s, 0) - w) <= max(20, 0.05 * w) for s, w in want.items())
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2

    out = stages["BPE"](spark, mixed, sf_dir)
    t = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    ids = lambda x: hashlib.sha256(",".join(map(str, t.encode(x, add_special_tokens=False).ids)).encode()).hexdigest()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in out.collect()) == sorted((r["doc_id"], ids(r["text"])) for r in mixed.collect())


def test_awkward_rows_in_every_stage(spark, sf_dir):
    """Nulls in any column, empty and long texts, ties and repeated rows, clashing columns: through the chain, and each stage on the raw rows."""
    words = "the river ran past the old mill and on to the sea where boats lay "
    rows = AWKWARD + [(None, words * 3, None, None), (None, words * 3, None, None), (20, words * 2 + "once", "en", None), (20, words * 2 + "once", "en", None), (21, words.upper() * 2 + "ONCE", None, "s"), (22, words * 9 + "twice", "xx", ""), (23, words * 9 + "thrice", "en", "s"), (24, words * 3000, "en", "s")]
    raw = documents(spark, rows, extra=True)
    docs = raw
    for name, stage in corpus_pipeline.STAGES:
        own, empty = stage(spark, raw, sf_dir), stage(spark, raw.where("false"), sf_dir)
        docs = stored(stage(spark, docs, sf_dir), "test")
        assert empty.count() == 0
        if name == "BPE":
            assert own.count() == len(rows)
        else:
            assert docs.columns == own.columns == empty.columns == raw.columns
            assert docs.count() > 0
            assert {r["lid_text"] for r in docs.select("lid_text").distinct().collect()} == {"own lid_text"}
        if name == "language ID":
            assert not {r["doc_id"] for r in docs.collect()} & {1, 2, 3, 13}
            assert {20, 21, 22, 23, 24, None} <= {r["doc_id"] for r in docs.collect()}
        if name == "exact dedup":
            kept = [lowered(r["text"]) for r in docs.collect()]
            assert len(kept) == len(set(kept))
        if name == "MinHash near-dedup":
            ids = [r["doc_id"] for r in docs.collect()]
            assert sorted(i for i in ids if i is not None) == sorted(set(components([r for r in before if r[0] is not None], 80).values()))
            assert len({21, 22, 23, 24} & set(ids)) == 1
        before = [(r["doc_id"], r["text"]) for r in docs.collect()] if name != "BPE" else []


def test_working_tables_are_removed(spark, sf_dir):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
    assert [p.name.split("-")[1] for p in set(folder.iterdir()) - before] == ["pipeline"]


def test_run(spark, sf_dir):
    first, again = (sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) for _ in range(2))
    assert first == again
    assert len(first) > 100
