"""A kept inverted index: postings by token in blocks of ids, merged batch by batch, and top-k search that skips blocks.

A batch of texts becomes a segment: a row for each token and block of BLOCK ids holds the postings (id,
length of the text, positions) and, beside them, how many there are, the largest count and the shortest
text. A bucket of tokens is a folder, whose rows are dealt by token and block to as many files as the texts
have tokens for, each in order of (token, block); so a query reads the buckets of its tokens and, of their
files, the row groups that can hold them; a frequent token is many rows, never one. What a task sorts, and
what its Python holds, does not grow with the texts. Segments are named in a commit log, so a batch that comes again adds nothing.

Top-k works on upper bounds: a block's is the sum of what its tokens could give at most, from the numbers
beside the postings. The most promising blocks are scored first; of the others only those whose bound
reaches the k-th score so far are read at all. Nothing is left out that could be among the first k.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.log import Log
from . import search
from .tables import arrow_bytes, stored

BLOCK, BUCKETS = 1024, 64
PIECE_TOKENS, PART_TOKENS, BATCH_BYTES = 1 << 17, 1 << 18, 1 << 22
FIRST_BLOCKS = 32
SLACK = 1e-9
POSTING = "struct<id:bigint,len:int,positions:array<int>>"
SCHEMA = f"token string, block long, n long, max_tf int, min_len int, postings array<{POSTING}>, bucket int"


def bucket_of(token: Column) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(BUCKETS)).cast("int")


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of the batch with at most PIECE_TOKENS tokens together, or one longer row."""
    total = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("ts")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PIECE_TOKENS, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, id, len, positions of rows(id, ts)."""
    pool = pa.default_memory_pool()
    for batch in (piece for whole in batches for piece in _pieces(whole)):
        pool.release_unused()
        lists = batch.column("ts")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        n, token = len(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if not n:
            continue
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = row * n + token
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
        at = order[starts]
        positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(place[order].astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(token[at])), batch.column("id").take(pa.array(row[at])), pa.array(sizes[row[at]].astype(np.int32)), positions],
            names=["token", "id", "len", "positions"],
        )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA from postings in order of token and block; what may go on in the next batch waits for it."""
    waits = None
    for batch in batches:
        if not len(batch):
            continue
        if waits is not None:
            batch = pa.concat_batches([waits, batch])
        token, block = batch.column("token"), batch.column("block").to_numpy()
        new = pc.not_equal(token.slice(1), token.slice(0, len(token) - 1)).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        waits = batch.slice(int(starts[-1]))
        if len(starts) > 1:
            yield _merged(batch.slice(0, int(starts[-1])), starts)
    if waits is not None and len(waits):
        yield _merged(waits, np.array([0, len(waits)]))


def _merged(batch: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
    starts = edges[:-1]
    at = pa.array(starts)
    tf, length = batch.column("positions").value_lengths().to_numpy(zero_copy_only=False), batch.column("len").to_numpy()
    postings = pa.StructArray.from_arrays([batch.column(c) for c in ("id", "len", "positions")], names=["id", "len", "positions"])
    columns = [
        batch.column("token").take(at), batch.column("block").take(at), pa.array(np.diff(edges).astype(np.int64)), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(length, starts)),
        pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), postings), batch.column("bucket").take(at),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["token", "block", "n", "max_tf", "min_len", "postings", "bucket"])


def _earlier(positions: Column, n: int) -> Column:
    return F.transform(positions, lambda x: x - n)


def _after(state: dict, entry: dict) -> dict:
    return {
        "segments": state["segments"] + [entry["segment"]], "docs": state["docs"] + entry["docs"], "tokens": state["tokens"] + entry["tokens"],
        "done": state["done"] | {entry["source"]: max(entry["number"], state["done"].get(entry["source"], -1))},
    }


class Index:
    """An index of texts below a folder. A text's id is added once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, folder, {"segments": [], "docs": 0, "tokens": 0, "done": {}}, _after)

    def add(self, docs: DataFrame, content: str, source: str, number: int) -> None:
        """Adds the texts of docs(id, content): batch `number` of a source, once however often it comes."""
        if number <= self.log.state()[1]["done"].get(source, -1):
            return
        split = stored(docs.where("id is not null").select("id", search.tokens(F.coalesce(F.col(content), F.lit(""))).alias("ts")), "split")
        docs_, tokens_ = split.agg(F.count("*"), F.coalesce(F.sum(F.size("ts")), F.lit(0))).first()
        rows = split.mapInArrow(_postings, "token string, id long, len int, positions array<int>").withColumns({"block": F.floor(F.col("id") / BLOCK), "bucket": bucket_of(F.col("token"))})
        parts = tokens_ // PART_TOKENS + 1
        part = F.pmod(F.xxhash64("token", "block"), F.lit(-(-parts // BUCKETS))).cast("int")
        dealt = rows.withColumn("part", part).repartition(parts, "bucket", "part")  # by hash: a range would look at all texts first
        blocks = dealt.drop("part").sortWithinPartitions("bucket", "token", "block", "id").mapInArrow(_blocks, SCHEMA)
        name = f"segments/{source}-{number}-{uuid.uuid4().hex}"
        with arrow_bytes(self.spark, BATCH_BYTES):
            blocks.write.partitionBy("bucket").parquet(f"{self.folder}/{name}")
        entry = {"segment": name, "docs": docs_, "tokens": tokens_, "source": source, "number": number}
        if self.log.append(lambda _, state: None if number <= state["done"].get(source, -1) else entry) is None:
            self.log.files.delete(name)

    def blocks(self, tokens: list[str]) -> DataFrame:
        """The index's rows of the tokens."""
        segments = self.log.state()[1]["segments"]
        if not segments or not tokens:
            return self.spark.createDataFrame([], SCHEMA)
        parts = [self.spark.read.schema(SCHEMA).option("basePath", f"{self.folder}/{s}").parquet(f"{self.folder}/{s}") for s in segments]
        buckets = [r["b"] for r in self.spark.createDataFrame([(t,) for t in tokens], "t string").select(bucket_of(F.col("t")).alias("b")).distinct().collect()]
        return reduce(DataFrame.unionByName, parts).where(F.col("bucket").isin(buckets) & F.col("token").isin(tokens))

    def matches(self, phrases: list[list[str]], within: DataFrame | None = None) -> DataFrame:
        """phrase_no, block, id, len, tf of the phrases (token lists) that occur, in the blocks of within(block) if given."""
        rows = self.blocks(sorted({t for p in phrases for t in p}))
        if within is not None:
            rows = rows.join(within, "block", "left_semi")
        out = []
        for single in (True, False):
            wanted = [(k, p) for k, p in enumerate(phrases) if p and (len(p) == 1) == single]
            if not wanted:
                continue
            numbers = self.spark.createDataFrame([(k, t) for k, p in wanted for t in sorted(set(p))], "phrase_no int, token string")
            found = rows.join(F.broadcast(numbers), "token").select("phrase_no", "token", "block", F.explode("postings").alias("p"))  # a row a token of the query
            if single:
                out.append(found.select("phrase_no", "block", "p.id", "p.len", F.size("p.positions").alias("tf")))
                continue
            whole = found.groupBy("phrase_no", "block", "p.id", "p.len").agg(F.map_from_entries(F.collect_list(F.struct("token", "p.positions"))).alias("at"))
            starts = [F.when(F.col("phrase_no") == k, reduce(F.array_intersect, [_earlier(F.col("at")[t], i) for i, t in enumerate(p)])) for k, p in wanted]
            out.append(whole.select("phrase_no", "block", "id", "len", F.size(F.coalesce(*starts, F.array().cast("array<int>"))).alias("tf")).where("tf > 0"))
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], "phrase_no int, block long, id long, len int, tf int")

    def _part(self, tf: Column, length: Column, df: Column) -> Column:
        state = self.log.state()[1]
        n, mean = float(state["docs"]), state["tokens"] / max(1, state["docs"])
        return search.bm25_part(tf, length, df, F.lit(n), F.lit(mean))

    def bm25(self, phrases: list[list[str]]) -> DataFrame:
        """id, score of all texts that hold any phrase."""
        found = stored(self.matches(phrases), "matches")
        return self._scores(found, found.groupBy("phrase_no").agg(F.count("*").alias("df")))

    def _scores(self, found: DataFrame, df: DataFrame) -> DataFrame:
        return found.join(F.broadcast(df), "phrase_no").groupBy("id").agg(F.sum(self._part(F.col("tf"), F.col("len"), F.col("df"))).alias("score"))  # df: a row a phrase

    def top(self, phrases: list[list[str]], k: int) -> DataFrame:
        """id, score of the k best texts, ties to smaller ids; reads what bounds can't rule out."""
        single = [(p[0], i) for i, p in enumerate(phrases) if len(p) == 1]
        words = self.blocks(sorted({t for t, _ in single})).select("token", "block", "n", "max_tf", "min_len")
        names = self.spark.createDataFrame(single, "token string, phrase_no int")
        meta = words.join(F.broadcast(names), "token").select("phrase_no", "block", "n", "max_tf", "min_len")
        if len(single) < len(phrases):  # counts of phrases need their positions, all of them
            longer = stored(self.matches([p if len(p) > 1 else [] for p in phrases]), "phrases")
            meta = meta.unionByName(longer.groupBy("phrase_no", "block").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len")))
        meta = stored(meta, "blocks")
        df = stored(meta.groupBy("phrase_no").agg(F.sum("n").alias("df")), "df")
        most = self._part(F.col("max_tf"), F.col("min_len"), F.col("df"))
        per = meta.join(F.broadcast(df), "phrase_no").groupBy("phrase_no", "block").agg(F.max(most).alias("most"))  # segments share a block, not its ids
        bounds = stored(per.groupBy("block").agg(F.sum("most").alias("bound")), "bounds")
        first = stored(bounds.orderBy(F.col("bound").desc(), "block").limit(FIRST_BLOCKS).select("block"), "first")
        best = stored(self._scores(self.matches(phrases, first), df).orderBy(F.col("score").desc(), "id").limit(k), "best")
        n, floor = best.agg(F.count("*"), F.min("score")).first()
        rest = bounds.join(first, "block", "left_anti")
        if n == k:
            rest = rest.where(F.col("bound") >= floor * (1 - SLACK))
        rest = stored(rest.select("block"), "rest")
        if rest.isEmpty():
            return best
        return best.unionByName(self._scores(self.matches(phrases, rest), df)).orderBy(F.col("score").desc(), "id").limit(k)
