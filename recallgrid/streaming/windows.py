"""Mining windows and attachment binding over micro-batches, in keyed state.

windows() keeps, for each conversation, its open window's number, counts and ids and the last message
placed, so a window goes on from batch to batch; many small batches place messages as one large one does.
A key of the state is a range of conversations, as each key costs calls between the JVM and Python.
bound() joins a stream of attachments to the stream of messages they came with, whichever comes first,
and keeps either side no longer than REACH_S plus the allowed delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.episodes import WINDOW_CHARS, WINDOW_MESSAGES

PLACED = "conversation_id long, id long, window_no int, msg_no int, closed array<struct<window_no:int,ids:array<bigint>,chars:bigint>>"
OPEN = "open array<struct<conversation_id:bigint,window_no:int,chars:bigint,last_id:bigint,ids:array<bigint>>>"
A_KEY = 32  # conversations
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REACH_S = 3600


class _Windows(StatefulProcessor):
    def __init__(self, most: int, chars: int) -> None:
        self.most, self.chars = most, chars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A range's new messages of a batch, in order of id; those at or below their conversation's last id were placed before."""
        opened = {c: (window, held, last, list(ids)) for c, window, held, last, ids in self.open.get()[0]} if self.open.exists() else {}
        out = []
        batch = pd.concat(list(rows))[["conversation_id", "id", "view_len"]].sort_values("id")
        homes = [None] * len(batch) if key[0] is None else batch["conversation_id"].tolist()
        for c, i, size in zip(homes, batch["id"].tolist(), batch["view_len"].tolist(), strict=True):
            window, held, last, ids = opened.get(c, (0, 0, None, []))
            if last is not None and i <= last:
                continue
            closed = []
            if not window or len(ids) >= self.most or held + size > self.chars:
                closed = [{"window_no": window, "ids": ids, "chars": held}] if window else []
                window, held, ids = window + 1, 0, []
            ids.append(i)
            opened[c] = (window, held + size, i, ids)
            out.append((c, i, window, len(ids), closed))
        if out:
            self.open.update(([(c, *kept) for c, kept in opened.items()],))
        yield pd.DataFrame(out, columns=["conversation_id", "id", "window_no", "msg_no", "closed"])

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """Keyed state needs the store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def windows(messages: DataFrame, most: int = WINDOW_MESSAGES, chars: int = WINDOW_CHARS) -> DataFrame:
    """conversation_id, id, window_no, msg_no of a stream of messages(conversation_id, id, view_len), as mining.windows places them.

    closed holds the window that the message ended, by its ids and characters. Messages must come with
    ids that rise from batch to batch (later ones get larger ids); a message that comes again is skipped.
    A batch holds ids and sizes of its own messages of a range of A_KEY conversations; state is one open window
    a conversation, at most `most` ids.
    """
    keyed_state(messages.sparkSession)
    sizes = messages.select(F.floor(F.col("conversation_id") / A_KEY).alias("range"), "conversation_id", "id", "view_len")
    return sizes.groupBy("range").transformWithStateInPandas(statefulProcessor=_Windows(most, chars), outputStructType=PLACED, outputMode="Append", timeMode="None")


def bound(attachments: DataFrame, messages: DataFrame, delay: str = "10 minutes", reach_s: int = REACH_S) -> DataFrame:
    """Streams of attachments and messages, left outer joined: message_id is null where no message within reach_s came.

    A pair comes out as soon as both sides are there; an attachment without one when the watermark has
    passed what could still come. settle() looks those up in the table of all messages.
    """
    theirs = messages.select(F.col("conversation_id").alias("m_conversation"), F.col("external_id").alias("m_external"), F.col("id").alias("message_id"), F.timestamp_seconds("created_at").alias("m_time")).withWatermark("m_time", delay)
    ours = attachments.withColumn("a_time", F.timestamp_seconds("created_at")).withWatermark("a_time", delay)
    near = F.expr(f"m_time BETWEEN a_time - INTERVAL {reach_s} SECONDS AND a_time + INTERVAL {reach_s} SECONDS")
    on = (F.col("conversation_id") == F.col("m_conversation")) & (F.col("message_external_id") == F.col("m_external")) & near
    return ours.join(theirs, on, "left_outer").drop("m_conversation", "m_external", "m_time", "a_time")


def settle(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """rows(conversation_id, message_external_id, message_id, ...) of a batch, null message_ids looked up in the messages so far."""
    known = messages.select("conversation_id", F.col("external_id").alias("message_external_id"), F.col("id").alias("found"))
    return rows.join(known, ["conversation_id", "message_external_id"], "left").withColumn("message_id", F.coalesce("message_id", "found")).drop("found").select(*rows.columns)
