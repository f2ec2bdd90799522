"""Incremental ingest and mining: file streams into exactly-once tables, id-based watermarks under leases.

The watermark is the largest message id mined in a conversation, not a time: late messages get larger
ids and are still mined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import episodes, mining
from .leases import TERM_S, Marks
from .sink import Table


def message_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def start(stream: DataFrame, table: Table, checkpoint: str, and_then: Callable[[DataFrame, int], None] | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Runs until all files that are there have been taken into the table; and_then must bear a batch that comes again."""

    def each(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        table.commit(prepare(batch) if prepare else batch, query, number)
        if and_then:
            and_then(batch, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def mine(messages: DataFrame, conversations: DataFrame, files: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """The windows of unmined messages, and conversations with their watermarks advanced; windows without a human turn advance too."""
    placed = mining.windows(episodes.with_bodies(episodes.unmined(messages, conversations), files))
    rows = mining.window_facts(placed, owner)
    marks = mining.watermarks(rows).withColumnRenamed("mined_upto", "new_mark")
    moved = conversations.join(marks, "id", "left").withColumn("mined_upto", F.coalesce("new_mark", "mined_upto")).drop("new_mark")
    return rows, moved


def mine_leased(marks: Marks, messages: DataFrame, conversations: DataFrame, files: DataFrame, owner: str, now: float, and_then: Callable[[DataFrame], None] | None = None, term: float = TERM_S) -> dict[str, int]:
    """Mines the conversations that no other run holds, and commits how far it got.

    and_then gets the windows before the marks move: if it fails, the lease is given back and they are mined again.
    """
    lease = marks.acquire(conversations, now, term)
    try:
        own = marks.conversations(conversations.join(lease.held, "id", "left_semi"))
        rows, moved = mine(messages.join(lease.held.withColumnRenamed("id", "conversation_id"), "conversation_id", "left_semi"), own, files, owner)
        if and_then:
            and_then(rows)
        refused = marks.advance(lease, moved)
    finally:
        marks.release(lease)
    return {"held": lease.held.count(), "skipped_locked": lease.skipped_locked, "refused": refused}
