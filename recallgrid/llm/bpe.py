"""Byte-level BPE by a distinct-word table, and decoding by an id-to-piece join.

Spark splits texts into words, each distinct word is merged once, and its ids are joined back by
position. Decoding goes the same way: the distinct ids of a packet of lists, a row each, are joined to their
pieces of the vocabulary, whose size is fixed, and the pieces are put in the places of the ids.

Defined results: null text counts as empty and has no ids; special-token strings in a text become their
ids; rows with a null or repeated doc_id are encoded like any other; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .arrays import tidy
from .word_blocks import block_table, by_distinct_word, put_back

# The split pattern of this family of vocabularies, its white space spelled out for Java.
SPACE = r"\p{IsWhite_Space}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
LONG_WORD = 64
# Text in a block, whose ids one task holds, and ids in a packet.
BLOCK_BYTES = 12 << 20
PACKET_TOKENS = 1 << 18


def byte_characters() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """pieces (bytes by id), ids (by bytes), ranks (of merges, by the two parts), special (ids by string)."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    byte_of = byte_characters()
    raw = lambda piece: bytes(byte_of[c] for c in piece)
    ids = {raw(p): i for p, i in data["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    pieces = {i: p for p, i in ids.items()} | {i: t.encode() for t, i in special.items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
    return {"pieces": [pieces.get(i, b"") for i in range(max(pieces) + 1)], "ids": ids, "ranks": {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}, "special": special}


def merge_word(word: bytes, ranks: dict) -> list[bytes]:
    """The parts of a word after merging, always the pair of lowest rank first, leftmost among equals."""
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > LONG_WORD:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        rank, at = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 60:
            break
        pair, out, i = (parts[at], parts[at + 1]), parts[:at], at
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def _merge_long(parts: list[bytes], ranks: dict) -> list[bytes]:
    """The same with a heap of pairs over a linked list, for words of any length."""
    n = len(parts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], after[i] = a + b, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (p := (parts[k], parts[after[k]])) in ranks:
                heapq.heappush(heap, (ranks[p], k, *p))
    return [p for p, there in zip(parts, alive, strict=True) if there]


def split_words(text: Column, special: list[str]) -> Column:
    """The words of a text in order, special-token strings among them; together they are the text."""
    words = lambda x: F.regexp_extract_all(x, F.lit(PATTERN), F.lit(0))
    if not special:
        return words(text)
    # of special tokens that begin at one place the longest counts; what lies between them is split on its own
    token = "|".join("\\Q" + t + "\\E" for t in sorted(special, key=len, reverse=True))
    sides, tokens = F.split(text, token, -1), F.regexp_extract_all(text, F.lit(f"(?:{token})"), F.lit(0))
    pieces = F.flatten(F.zip_with(sides, tokens, lambda x, t: F.concat(words(x), F.filter(F.array(t), lambda y: y.isNotNull()))))
    some = [F.contains(text, F.lit(t)) for t in special]
    return F.when(reduce(lambda a, b: a | b, some), pieces).otherwise(words(text))


def encode(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids array<int> of each row of docs, whole texts."""
    vocabulary = load_vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast({k: vocabulary[k] for k in ("ids", "ranks", "special")})

    def work(words: list[str]) -> list[list[int]]:
        v = shared.value
        return [[v["special"][w]] if w in v["special"] else [v["ids"][p] for p in merge_word(w.encode(), v["ranks"])] for w in words]

    def finish(doc_ids: pa.Array, counts: np.ndarray, lists: pa.ListArray) -> pa.Table:
        tokens = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)])
        ends = tokens[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), lists.flatten())
        return pa.table({"doc_id": doc_ids, "ids": ids})

    text = F.coalesce("text", F.lit(""))
    blocks = block_table(docs.select("doc_id", split_words(text, list(vocabulary["special"])).alias("words")), block_bytes)
    return put_back(blocks, by_distinct_word(blocks, work), finish, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded with a column decoded: the pieces of ids joined in order, as UTF-8 (invalid bytes: U+FFFD). Null ids give null.

    A packet of lists is followed by a row for each distinct id in it; these are joined to their pieces of
    the vocabulary. That table has a fixed size and goes to every task, so a packet's rows stay together and
    in order, and its pieces are put in the places of the ids. An id outside the vocabulary, or null, has no piece.
    """
    spark = coded.sparkSession
    known = load_vocabulary(path)["pieces"]
    pieces = spark.createDataFrame(pa.table({"token": pa.array(range(len(known)), pa.int32()), "piece": pa.array(known, pa.binary())}))
    kept = coded.drop("ids", "decoded")
    ids = ArrayType(IntegerType())
    doc = F.struct(*(coded[f"`{c}`"] for c in kept.columns)).alias("doc")
    packets = StructType([StructField("docs", ArrayType(kept.schema)), StructField("lists", ArrayType(ids)), StructField("token", IntegerType())])
    tokens = coded.select(doc, "ids").mapInArrow(tidy(_packets), packets)
    joined = tokens.join(F.broadcast(pieces), "token", "left").select("docs", "lists", "piece")
    whole = joined.mapInArrow(tidy(_unpacked), StructType([StructField("doc", kept.schema), StructField("ids", ids), StructField("decoded", BinaryType())]))
    return whole.select("doc.*", "ids", F.make_valid_utf8(F.col("decoded").cast("string")).alias("decoded"))


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of documents and their lists, at most PACKET_TOKENS ids or one longer list, and after it a row for each distinct id, by first place."""
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(total):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + PACKET_TOKENS, side="right")))
            docs, lists = (batch.column(c).slice(at, end - at) for c in ("doc", "ids"))
            distinct = lists.flatten().dictionary_encode().dictionary
            edges, below = [0] + [end - at] * (len(distinct) + 1), pa.array([False] + [True] * len(distinct))
            columns = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), x, mask=below) for x in (docs, lists)]
            yield pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(1, pa.int32()), distinct])], names=["docs", "lists", "token"])
            at = end


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of packets whose rows have their pieces."""
    docs, lists, pieces = None, None, []
    for batch in batches:
        heads = np.flatnonzero(batch.column("docs").is_valid().to_numpy(zero_copy_only=False))
        edges = [*heads, batch.num_rows]
        pieces.append(batch.column("piece").slice(0, edges[0]))
        for head, end in zip(edges[:-1], edges[1:], strict=True):
            if docs is not None:
                yield _filled(docs, lists, pa.concat_arrays(pieces))
            docs, lists, pieces = batch.column("docs")[head].values, batch.column("lists")[head].values, [batch.column("piece").slice(head + 1, end - head - 1)]
    if docs is not None:
        yield _filled(docs, lists, pa.concat_arrays(pieces))


def _filled(docs: pa.Array, lists: pa.ListArray, pieces: pa.BinaryArray) -> pa.RecordBatch:
    """The lists, and for each the pieces of its ids one after another; pieces are those of the distinct ids."""
    spelled = pieces.take(lists.flatten().dictionary_encode().indices)
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), dtype=np.int64)])
    _, at, data = spelled.buffers()
    at = np.frombuffer(at, dtype=np.int32)[spelled.offset : spelled.offset + len(spelled) + 1] if len(spelled) else np.zeros(1, dtype=np.int32)
    whole = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at[ends].tobytes()), data])
    return pa.RecordBatch.from_arrays([docs, lists, pc.if_else(lists.is_null(), pa.scalar(None, pa.binary()), whole)], names=["doc", "ids", "decoded"])
