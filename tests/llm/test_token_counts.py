"""Token counts: brute-force segmentation, shared prefixes, awkward rows."""

from __future__ import annotations

import bisect
import os

import pytest
from helpers import AWKWARD, documents, word_list

from recallgrid.llm import queries, token_counts, word_blocks

PATH = queries.tokenizer("piece_bpe_32k.model")


def brute(word: str, pieces: dict[str, float], unknown: float, longest: int) -> int:
    """Tokens of the best segmentation; of equal scores the fewest."""
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] + unknown, -(best[end - 1][1] + len(word[end - 1].encode())))]
        options += [(best[s][0] + pieces[word[s:end]], -best[s][1] - 1) for s in range(max(0, end - longest), end) if word[s:end] in pieces]
        score, n = max(options)
        best[end] = (score, -n)
    return best[-1][1]


def check(out, texts):
    """out(doc_id, n_words, n_tokens) against words segmented one by one."""
    pieces = token_counts.load_pieces(PATH)
    unknown, longest, known = min(pieces.values()) - token_counts.UNKNOWN_PENALTY, max(map(len, pieces)), {}
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        words = word_list(texts[r["doc_id"]])
        for w in words:
            if w not in known:
                known[w] = brute("▁" + w, pieces, unknown, longest)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(queries.op2_token_counts(spark, sf_dir).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def test_small_blocks_and_long_words(spark):
    docs = documents(spark, AWKWARD, extra=True).repartition(3)
    check(token_counts.token_counts(docs, PATH, block_bytes=2000).collect(), {r[0]: r[1] for r in AWKWARD})


def test_prefixes_are_shared_over_many_tasks(spark):
    """Nodes walked by 211 tasks are hardly more than those of one trie."""
    words = sorted({w for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() for w in word_list(r["text"])})
    table = word_blocks.block_table(spark.createDataFrame([(k, words[k::7]) for k in range(7)], "doc_id long, words array<string>"), 100_000)
    edges = word_blocks.word_ranges(table, 211 * word_blocks.RANGES_A_TASK)
    steps = lambda ws: sum(len(b) - len(os.path.commonprefix([a, b])) for a, b in zip([""] + ws[:-1], ws, strict=True))
    cuts = [0, *(bisect.bisect_left(words, e) for e in edges), len(words)]
    parts = [words[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    assert len(edges) > 700
    assert max(map(len, parts)) < 4 * len(words) / len(parts)
    assert sum(map(steps, parts)) < 1.1 * steps(words)


def test_prefixes_are_walked_once():
    walk = token_counts.TrieWalk({"a": -1.0, "b": -2.0, "ab": -2.5})
    assert [walk.count(w) for w in ("aab", "aabb", "ab")] == [2, 3, 1]
    assert walk.nodes == 3 + 1 + 1


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD + [(None, "a b"), (None, "a b"), (4, "One two three")], extra=True)
    out = token_counts.token_counts(docs, PATH).collect()
    assert len(out) == docs.count()
    counts = {}
    for r in out:
        counts.setdefault(r["doc_id"], []).append((r["n_words"], r["n_tokens"]))
    assert counts[1] == counts[2] == counts[3] == [(0, 0)]
    assert counts[10][0][0] == 60_000
    assert counts[4][0] == counts[4][1]
    assert counts[None][0] == counts[None][1]
    assert token_counts.token_counts(docs.where("false"), PATH).count() == 0


@pytest.mark.parametrize("word", ["", "\U0001f642", "é"])
def test_unknown_characters_count_bytes(word):
    assert token_counts.TrieWalk({"q": -1.0}).count(word) == len(word.encode())
