"""The distinct-word table: what both tokenizer operators share.

Documents are cut into blocks of consecutive rows. A block keeps its documents as indexes into its sorted
distinct words, and those words in lists. From every MARK_EVERY-th word of all blocks Spark makes ranges
of words of about equal weight; a block's lists are cut at their edges, and a range of all blocks meets in
one task. So words with a common beginning stay together, a beginning that many words share is cut
further, equal words of all blocks are neighbours, and each distinct word of the corpus is worked on once,
in a stream. What was found goes back to the block by rank and is put in the places of the words. The
block table is bucketed by block, so that documents never move.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import tidy
from .storage import arrow_rows, new_path, new_table

BLOCK_BYTES = 24 << 20
WORDS_TOGETHER = 200_000
DOCS_TOGETHER = 256
ROWS_A_BATCH = 512
WORDS_A_LIST, MARK_EVERY, RANGES_A_TASK = 1 << 14, 64, 4
# kind: DOCS rows hold documents, WORDS rows a stretch of the block's words from rank first on, MARKS rows some of them.
DOCS, WORDS, MARKS = 0, 1, 2
BLOCK_SCHEMA = "block long, kind int, first int, words array<string>, doc_ids array<long>, counts array<int>, indexes binary"


def _planes(indexes: np.ndarray) -> bytes:
    """int32 values as four byte planes, which compress better."""
    return np.ascontiguousarray(indexes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<i4").reshape(-1)


def _block(number: int, ids: list, lists: list) -> Iterator[pa.RecordBatch]:
    counts = pa.concat_arrays([pc.fill_null(pc.list_value_length(x), 0) for x in lists])
    coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    words = coded.dictionary.take(pa.array(order))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    at = coded.indices.to_numpy(zero_copy_only=False)
    yield from _homes(number, pa.concat_arrays(ids), counts, place[at] if len(at) else np.empty(0, dtype=np.int64))
    for k in range(0, len(words), WORDS_A_LIST):
        yield _words(number, WORDS, k, words.slice(k, WORDS_A_LIST))
    for k in range(0, len(words), WORDS_A_LIST * MARK_EVERY):
        marks = words.take(pa.array(np.arange(k, min(len(words), k + WORDS_A_LIST * MARK_EVERY), MARK_EVERY)))
        yield _words(number, MARKS, k, marks)


def _words(number: int, kind: int, first: int, words: pa.Array) -> pa.RecordBatch:
    columns = [pa.array([number], pa.int64()), pa.array([kind], pa.int32()), pa.array([first], pa.int32()), pa.ListArray.from_arrays([0, len(words)], words), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "kind", "first", "words", "doc_ids", "counts", "indexes"])


def _homes(number: int, ids: pa.Array, counts: pa.Array, indexes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A block's documents, DOCS_TOGETHER a row."""
    ends = np.concatenate([[0], np.cumsum(counts.to_numpy(zero_copy_only=False), dtype=np.int64)])
    for k in range(0, len(ids), DOCS_TOGETHER):
        n = min(k + DOCS_TOGETHER, len(ids)) - k
        data = pa.array([_planes(indexes[ends[k] : ends[k + n]])], pa.binary())
        columns = [pa.array([number], pa.int64()), pa.array([DOCS], pa.int32()), pa.array([k], pa.int32()), pa.nulls(1, pa.list_(pa.string())), pa.ListArray.from_arrays([0, n], ids[k : k + n]), pa.ListArray.from_arrays([0, n], counts[k : k + n].cast(pa.int32())), data]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "kind", "first", "words", "doc_ids", "counts", "indexes"])


def _cut(block_bytes: int):
    def run(batches):
        number, ids, lists, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids.append(part.column("doc_id"))
                lists.append(part.column("words"))
                size += part.column("words").nbytes
                if size >= block_bytes:
                    yield from _block(number, ids, lists)
                    number, ids, lists, size = number + 1, [], [], 0
        if ids:
            yield from _block(number, ids, lists)

    return run


def block_table(words: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """words(doc_id, words array<string>) as a table of blocks: their documents, words and marks.

    It is a table of the catalog, as only those are bucketed; storage.scratch drops it.
    """
    spark = words.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = new_table("blocks")
    # the text bytes are about half of what Arrow holds for short words
    rows = words.select("doc_id", "words").mapInArrow(tidy(_cut(2 * block_bytes)), BLOCK_SCHEMA)
    with arrow_rows(spark, ROWS_A_BATCH):
        rows.write.option("compression", "zstd").option("path", new_path(spark, "blocks")).bucketBy(buckets, "block").format("parquet").saveAsTable(name)
    return spark.table(name)


def word_ranges(blocks: DataFrame, ranges: int) -> list[str]:
    """The first words of at most so many ranges with about equally many marks each, but of the first range."""
    marks = blocks.where(F.col("kind") == MARKS).select(F.explode("words").alias("word"))
    firsts = marks.repartitionByRange(ranges, "word").groupBy(F.spark_partition_id().alias("range")).agg(F.min("word").alias("word"))
    return sorted(r["word"] for r in firsts.collect())[1:]


def _at_edges(edges: list[str]):
    """Stretches of a block's words cut where ranges begin."""

    def run(batches):
        for batch in batches:
            rows = []
            for block, first, words in zip(batch.column("block").to_pylist(), batch.column("first").to_pylist(), batch.column("words"), strict=True):
                own = words.values
                k, at = bisect_right(edges, own[0].as_py()), 0
                while at < len(own):
                    end = bisect_left(own, edges[k], at, key=lambda w: w.as_py()) if k < len(edges) else len(own)
                    if end > at:
                        rows.append((block, k, first + at, own[at:end]))
                    at, k = end, k + 1
            sizes = np.cumsum([0, *(len(r[3]) for r in rows)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.concat_arrays([r[3] for r in rows]) if rows else pa.array([], pa.string()))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], kind) for i, kind in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))), lists], names=["block", "range", "first", "words"])

    return run


def by_distinct_word(blocks: DataFrame, work: Callable[[list[str]], list[list[int]]]) -> DataFrame:
    """block, range, ranks, sizes, values: work's numbers for each distinct word, sent back to its blocks.

    work gets the sorted distinct words of a stretch of a range, each word of the corpus once in all.
    """

    def packed(held: list[tuple]) -> pa.RecordBatch:
        """One row for each block and range: the words' ranks (as steps), how many numbers each has, and the numbers."""
        block, bucket, rank, sizes = (np.concatenate([h[k] for h in held]) for k in range(4))
        values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.concat_arrays([h[4] for h in held]))
        order = np.lexsort((rank, bucket, block))
        block, bucket, rank, sizes = block[order], bucket[order], rank[order], sizes[order]
        values = values.take(pa.array(order)).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        heads = np.concatenate([[0], np.flatnonzero(np.diff(block) | np.diff(bucket)) + 1, [len(block)]])
        rows = [(int(block[a]), int(bucket[a]), _planes(np.diff(rank[a:b], prepend=0)), _planes(sizes[a:b]), _planes(values[ends[a] : ends[b]])) for a, b in zip(heads[:-1], heads[1:], strict=True)]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "range", "ranks", "sizes", "values"])

    def run(batches):
        last, known, held, n = None, [], [], 0
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            fresh = words[1:] if words and words[0] == last else words
            found = ([known] if len(fresh) < len(words) else []) + work(fresh)
            last, known = words[-1] if words else last, found[-1] if found else known
            sizes = np.array([len(x) for x in found], dtype=np.int64)
            values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array([v for x in found for v in x], pa.int32()))
            at = coded.indices.to_numpy()
            held.append((batch.column("block").to_numpy(), batch.column("range").to_numpy(), batch.column("rank").to_numpy(), sizes[at], values.take(pa.array(at)).flatten()))
            n += batch.num_rows
            if n >= WORDS_TOGETHER:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = word_ranges(blocks, tasks * RANGES_A_TASK)
    lists = blocks.where(F.col("kind") == WORDS).select("block", "first", "words").mapInArrow(tidy(_at_edges(edges)), "block long, range int, first int, words array<string>")
    sent = lists.repartition("range").select("block", "range", "first", F.posexplode("words").alias("pos", "word"))
    return sent.select("block", "range", (F.col("first") + F.col("pos")).alias("rank"), "word").sortWithinPartitions("word").mapInArrow(tidy(run), "block long, range int, ranks binary, sizes binary, values binary")


def put_back(blocks: DataFrame, found: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """finish(doc_ids, counts, lists) of each block: its documents' ids, words per document and, word by word, the numbers found."""

    def run(key, left, right):
        left = left.filter(pc.equal(left["kind"], DOCS)).combine_chunks()
        part = lambda c, i: _from_planes(right[c][i].as_py())
        none = [np.empty(0, dtype=np.int32)]
        every = range(right.num_rows)
        sizes = np.concatenate(none + [part("sizes", i) for i in every])
        rank = np.concatenate(none + [np.cumsum(part("ranks", i)) for i in every])
        values = np.concatenate(none + [part("values", i) for i in every])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, pa.int32()))
        lists = lists.take(pa.array(np.argsort(rank, kind="stable")))
        done = []
        for i in range(left.num_rows):
            at, ids, counts = _from_planes(left["indexes"][i].as_py()), left["doc_ids"][i].values, left["counts"][i].values.to_numpy()
            done.append(finish(ids, counts, lists.take(pa.array(at))))
        return pa.concat_tables(done)

    home = blocks.where(F.col("kind") == DOCS).select("block", "kind", "doc_ids", "counts", "indexes")
    return home.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema)
