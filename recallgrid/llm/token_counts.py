"""Token counts under a unigram tokenizer by dynamic programming over a trie of the distinct words.

Words ([^\\x20\\x09-\\x0D]+, each with the word mark in front) are gathered in the distinct-word table.
Words are dealt to tasks by ranges, which begin with a common beginning or cut one that very many words
share, so that the tries of all tasks together have hardly more nodes than one. A task walks its sorted
words as the depth-first order of its trie: the forward score of a node (best score of any segmentation of
the characters from the root to it) is computed once for all words that share the prefix, and a word's
token count is stored where it ends. Scores are the vocabulary
file's own; a character that no piece covers costs UNKNOWN_PENALTY below the lowest score and counts
one token per UTF-8 byte. Of equal scores the smaller count wins.

Defined results: null, empty and blank texts have 0 words and 0 tokens; rows with a null or repeated
doc_id are counted like any other; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_blocks import BLOCK_BYTES, block_table, by_distinct_word, put_back

WORD_MARK = "▁"
UNKNOWN_PENALTY = 10.0
WORD = r"[^\x20\x09-\x0D]+"


def load_pieces(path: str) -> dict[str, float]:
    """Scores by piece of a sentencepiece vocabulary file, without control, byte and unknown pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return {model.id_to_piece(i): model.get_score(i) for i in ids}


class TrieWalk:
    """Forward scores along the current path of a trie; words must come in sorted order to share them."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.path, self.best = "", [(0.0, 0)]
        self.nodes = 0

    def count(self, word: str) -> int:
        """Tokens of the best segmentation of word."""
        shared, limit = 0, min(len(word), len(self.path))
        while shared < limit and word[shared] == self.path[shared]:
            shared += 1
        best = self.best
        del best[shared + 1 :]
        pieces, longest = self.pieces, self.longest
        for end in range(shared + 1, len(word) + 1):
            score, n = best[end - 1]
            top = (score + self.unknown, -(n + len(word[end - 1].encode())))
            for start in range(max(0, end - longest), end):
                own = pieces.get(word[start:end])
                if own is not None:
                    score, n = best[start]
                    top = max(top, (score + own, -n - 1))
            best.append((top[0], -top[1]))
        self.nodes += len(word) - shared
        self.path = word
        return best[-1][1]


def token_counts(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_tokens of each row of docs, whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))
    walks: dict[int, TrieWalk] = {}

    def work(words: list[str]) -> list[list[int]]:
        walk = walks.setdefault(0, TrieWalk(shared.value))
        return [[walk.count(WORD_MARK + w)] for w in words]

    def finish(doc_ids: pa.Array, counts: np.ndarray, lists: pa.ListArray) -> pa.Table:
        total = np.concatenate([[0], np.cumsum(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return pa.table({"doc_id": doc_ids, "n_words": pc.cast(pa.array(counts), pa.int64()), "n_tokens": pa.array(np.diff(total[ends]))})

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    blocks = block_table(docs.select("doc_id", words.alias("words")), block_bytes)
    return put_back(blocks, by_distinct_word(blocks, work), finish, "doc_id long, n_words long, n_tokens long")
