"""The kept index: same scores as splitting every text, top-k that skips blocks, batches, accents, snippets."""

from __future__ import annotations

import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallgrid.operators import index, search

TEXTS = "id long, content string"


def texts(spark, rows):
    return spark.createDataFrame(rows, TEXTS).repartition(3)


def scores(df, digits=9):
    return sorted((r["id"], round(r["score"], digits)) for r in df.collect())


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = ["the"] * 6 + ["over", "tion", "with", "Müller", "x-y"] + [f"w{k}" for k in range(300)]
    return [(i * 37 % 5003, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 200])))) for i in range(n)]


QUERIES = ["muller w7 w8", "over-the tion-with", "the the the-the w1", "w3 absent-the absent"]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    rows = corpus(400) + [(9000, None), (9001, ""), (9002, "the " * 3000)]
    made = index.Index(spark, str(tmp_path_factory.mktemp("index")))
    for k in range(4):
        made.add(texts(spark, rows[k::4]), "content", "chat", k)
    made.add(texts(spark, rows[3::4]), "content", "chat", 3)  # a batch that comes again
    return made, texts(spark, [(i, t or "") for i, t in rows]).cache()


@pytest.mark.parametrize("query", QUERIES)
def test_same_scores_as_without_an_index(built, query):
    made, docs = built
    assert scores(made.bm25(search.parse_query(query))) == scores(search.bm25(docs, "content", search.parse_query(query)))


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("k", [3])
def test_top_is_exact_however_few_blocks_come_first(built, monkeypatch, query, k):
    made, docs = built
    monkeypatch.setattr(index, "FIRST_BLOCKS", 1)
    want = search.bm25(docs, "content", search.parse_query(query)).orderBy(F.col("score").desc(), "id").limit(k)
    assert scores(made.top(search.parse_query(query), k)) == scores(want)


def test_blocks_below_the_bound_are_not_read(spark, tmp_path, monkeypatch):
    """Rare words in one block: the other blocks of a frequent word are ruled out before their postings are read."""
    rows = [(i, "the " + "filler " * 50) for i in range(0, 20 * index.BLOCK, 97)] + [(5, "the needle")]
    made = index.Index(spark, str(tmp_path / "index"))
    made.add(texts(spark, rows), "content", "a", 0)
    monkeypatch.setattr(index, "FIRST_BLOCKS", 1)
    seen, matches = [], index.Index.matches
    monkeypatch.setattr(index.Index, "matches", lambda self, p, within=None: (seen.append(within.count()), matches(self, p, within))[1])
    assert [r["id"] for r in made.top([["the"], ["needle"]], 1).collect()] == [5]
    assert seen == [1]


def test_only_the_buckets_of_the_query_are_scanned(built):
    made, _ = built
    plan = made.blocks(["the", "w7"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(token" in plan


def test_empty_index(spark, tmp_path):
    made = index.Index(spark, str(tmp_path / "index"))
    assert made.bm25([["the"]]).count() == 0 and made.top([["the"]], 5).count() == 0
    made.add(texts(spark, [(1, None), (None, "the")]), "content", "a", 0)
    assert made.bm25([["the"]]).count() == 0 and made.top([["the"], ["a", "b"]], 5).count() == 0


def test_accents(spark):
    said = ["Müller", "MULLER", "Müller", "Ếάй", "straße ø", "が"]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in said], "s string").select(search.tokens(F.col("s"))).collect()]
    assert got[:3] == [["muller"]] * 3 and got[3] == ["eαи"] and got[4] == ["straße", "ø"] and got[5] == ["が"]
    assert search.parse_query("Müller Été") == [["muller"], ["ete"]]
    letters, bare = search.accents()
    assert all(unicodedata.normalize("NFD", a)[0] == b for a, b in zip(letters, bare))


def best_window(text, words):
    parts = text.split()
    hit = [any(t in words for t in "".join(c if c.isalnum() else " " for c in w.lower()).split()) for w in parts]
    counts = [sum(hit[i : i + 24]) for i in range(len(parts))] or [0]
    at = counts.index(max(counts))
    shown = " ".join(f">>{w}<<" if h else w for w, h in list(zip(parts, hit))[at : at + 24])
    return (" … " if at else "") + shown + (" … " if at + 24 < len(parts) else "")


def test_snippets_show_the_best_window(spark):
    rng = random.Random(4)
    said = [" ".join(rng.choice(["the", "Tion,", "a", "b", "c", "d", "e", "f"][: rng.randrange(2, 9)]) for _ in range(rng.choice([0, 1, 5, 23, 24, 25, 80, 300]))) for _ in range(150)] + ["x " * 100 + "the " + "y " * 30 + "the tion the"]
    got = spark.createDataFrame(list(enumerate(said)), TEXTS).select("id", search.snippet(F.col("content"), ["the", "tion"]).alias("s")).collect()
    assert {r["id"]: r["s"] for r in got} == {i: best_window(t, {"the", "tion"}) for i, t in enumerate(said)}


def test_parts_are_bounded(spark, tmp_path, monkeypatch):
    """Parts grow in number with the texts; what is found is the same."""
    monkeypatch.setattr(index, "BLOCK", 8)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 37}" for k in range(1, 40))) for i in range(300)], "id long, content string").coalesce(1)
    plain, small = index.Index(spark, str(tmp_path / "plain")), index.Index(spark, str(tmp_path / "small"))
    plain.add(docs, "content", "s", 0)
    monkeypatch.setattr(index, "PART_TOKENS", 50)
    small.add(docs, "content", "s", 0)
    found = [sorted(map(tuple, x.bm25([["w1"], ["w2", "w4"]]).collect())) for x in (plain, small)]
    assert found[0] == found[1] and len(found[0]) > 30
    assert len(small.blocks(["w1"]).inputFiles()) > len(plain.blocks(["w1"]).inputFiles())


def test_python_takes_few_tokens_at_once(monkeypatch):
    monkeypatch.setattr(index, "PIECE_TOKENS", 100)
    ts = [["a"] * n for n in (30, 60, 10, 250, 1, 0, 99, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(ts, pa.list_(pa.string()))], names=["id", "ts"])
    assert [p.column("id").to_pylist() for p in index._pieces(batch)] == [[0, 1, 2], [3], [4, 5, 6], [7, 8]]
    rows = [(t, i, n, len(at)) for out in index._postings([batch]) for t, i, n, at in zip(*(out.column(c).to_pylist() for c in ("token", "id", "len", "positions")), strict=True)]
    assert rows == [("a", i, len(x), len(x)) for i, x in enumerate(ts) if x]
