"""Mining: bounded windows of new messages, transcripts, and the parsing and judging of extracted lines.

Windows and lines are pure DataFrame work; the language model sits between them as a callable in
mapInPandas, so both halves are tested without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from .episodes import WINDOW_CHARS, WINDOW_MESSAGES
from .settle import claim_action

HEAD = r"(?s)^NEW\b([^:]*):\s*(.*)$"
# Fixed wordings: stored reasons must be equal.
UNSCORED = "importance: miner omitted or malformed importance= and did not supply it on retry — unscored, score it before trusting"
UNBOUND = "speaker-trust: no valid src= binding in a session with guest or unrecognised speakers — cannot attribute this fact to the owner"


def windows(messages: DataFrame, most: int = WINDOW_MESSAGES, chars: int = WINDOW_CHARS) -> DataFrame:
    """messages(conversation_id, id, view_len, ...) with window_no and msg_no (both from 1).

    A window takes messages in id order while it has at most `most` and `chars` characters; it always has
    one. Where a window ends depends on where it began, so a conversation's ids and sizes pass through one
    task in order, in a stream that holds a batch; the texts stay where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, window, n, held = None, 0, 0, 0
        for batch in batches:
            out = []
            for conversation, size in zip(batch.column("conversation_id").to_pylist(), batch.column("view_len").to_pylist(), strict=True):
                if conversation != at or not window:
                    at, window, n, held = conversation, 1, 0, 0
                elif n >= most or held + size > chars:
                    window, n, held = window + 1, 0, 0
                n, held = n + 1, held + size
                out.append((window, n))
            yield pa.RecordBatch.from_arrays([batch.column("conversation_id"), batch.column("id"), *(pa.array([o[k] for o in out], pa.int32()) for k in (0, 1))], names=["conversation_id", "id", "window_no", "msg_no"])

    sizes = messages.select("conversation_id", "id", "view_len").repartition("conversation_id").sortWithinPartitions("conversation_id", "id")
    placed = sizes.mapInArrow(run, "conversation_id long, id long, window_no int, msg_no int")
    return messages.join(placed, ["conversation_id", "id"])


def window_facts(placed: DataFrame, owner: str) -> DataFrame:
    """One row a window: last_id, mined (has a human turn), untrusted (has a turn that needs review), transcript."""
    line = F.concat(F.lit("[msg "), F.col("msg_no").cast("string"), F.lit("] "), text.speaker_label(F.col("speaker"), owner), F.lit(": "), F.col("body"))
    rows = placed.groupBy("conversation_id", "window_no").agg(
        F.max("id").alias("last_id"), F.count("*").alias("n_messages"), F.bool_or(text.human_speaker(F.col("speaker"))).alias("mined"),
        F.bool_or(text.speaker_flag(F.col("speaker")).isNotNull()).alias("untrusted"), F.array_sort(F.collect_list(F.struct("msg_no", line.alias("line")))).alias("lines"),
    )
    return rows.withColumn("transcript", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")).drop("lines")


def watermarks(window_rows: DataFrame) -> DataFrame:
    return window_rows.groupBy(F.col("conversation_id").alias("id")).agg(F.max("last_id").alias("mined_upto"))


def extract(window_rows: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """conversation_id, window_no, line_no, line: what the model says of each mined window's transcript."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"conversation_id": f["conversation_id"], "window_no": f["window_no"], "reply": [complete(t) or "" for t in f["transcript"]]})

    said = window_rows.where("mined").select("conversation_id", "window_no", "transcript").mapInPandas(run, "conversation_id long, window_no int, reply string")
    return said.select("conversation_id", "window_no", F.posexplode(F.split("reply", "\n")).alias("line_no", "line"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines(line, ...) that are facts, with fact, src, importance (1 to 9), event, supersedes and drop (reason or null)."""
    bare = F.trim(F.regexp_replace(F.trim("line"), "^[-• ]+", ""))
    attrs, fact = F.regexp_extract(bare, HEAD, 1), F.trim(F.regexp_extract(bare, HEAD, 2))
    number = lambda pattern: F.when(F.regexp_extract(attrs, pattern, 1) != "", F.regexp_extract(attrs, pattern, 1).cast("int"))
    importance = number(r"importance=(\d{1,2})\b")
    event = F.regexp_extract(attrs, r"event=(\d{4}-\d{2}-\d{2})", 1)
    ids = F.regexp_extract(attrs, r"supersedes=(\d+(?:\s*,\s*\d+)*)", 1)
    out = lines.where((F.upper(bare) != "NONE") & bare.rlike(HEAD) & (F.length(fact) >= 8))
    parsed = {
        "fact": fact, "src": number(r"src=(\d+)\b"), "importance": F.when(importance.isNotNull(), scoring.clamp(importance, 1, 9)), "event": F.when(event != "", event),
        "supersedes": F.transform(F.filter(F.split(ids, r"\s*,\s*"), lambda x: x != ""), lambda x: x.cast("long")),
        "drop": F.when(text.is_system_meta(fact), "system-meta").when(text.is_builder_process(fact), "builder-process"),
    }
    return out.withColumns(parsed)


def drop_counts(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("drop").isNotNull()).groupBy(F.col("drop").alias("reason")).agg(F.count("*").alias("n"))


def grounded_event(event: Column, source: Column, reference: Column) -> Column:
    """Epoch of an ISO date whose month and day are written in source (its year too, or none, which takes that of reference); else null."""
    day = F.try_to_date(event, "yyyy-MM-dd")
    fits = F.filter(text.explicit_dates(source), lambda d: (d["month"] == F.month(day)) & (d["day"] == F.dayofmonth(day)) & F.coalesce(d["year"] == F.year(day), F.lit(True)))
    found = F.get(fits, 0)
    year = F.coalesce(found["year"], F.year(F.timestamp_seconds(reference)))
    made = F.try_to_date(F.format_string("%04d-%02d-%02d", year, found["month"], found["day"]), "yyyy-MM-dd")
    return F.when(F.size(fits) > 0, F.unix_timestamp(made.cast("timestamp")).cast("double"))


def bind(parsed: DataFrame, placed: DataFrame) -> DataFrame:
    """parsed lines with the message that src names, or the window's last message where it names none.

    bound, bound_id, bound_at, bound_body, bound_speaker.
    """
    turns = placed.select("conversation_id", "window_no", F.col("msg_no").alias("src"), F.col("id").alias("b_id"), F.col("created_at").alias("b_at"), F.col("body").alias("b_body"), F.col("speaker").alias("b_speaker"))
    last = placed.groupBy("conversation_id", "window_no").agg(F.max("id").alias("l_id"), F.max_by("created_at", "id").alias("l_at"))
    out = parsed.join(turns, ["conversation_id", "window_no", "src"], "left").join(last, ["conversation_id", "window_no"])
    return out.withColumns({"bound": F.col("b_id").isNotNull(), "bound_id": F.coalesce("b_id", "l_id"), "bound_at": F.coalesce("b_at", "l_at"), "bound_body": F.col("b_body"), "bound_speaker": F.col("b_speaker")}).drop("b_id", "l_id", "b_at", "l_at", "b_body", "b_speaker")


def judge(bound: DataFrame, window_rows: DataFrame, allowed: list[str], source_app: str) -> DataFrame:
    """Candidate rows for the write gate: event date, flags as quarantine reason, confidence."""
    rows = bound.where(F.col("drop").isNull()).join(window_rows.select("conversation_id", "window_no", "transcript", "untrusted"), ["conversation_id", "window_no"])
    event = F.when(F.col("bound"), F.coalesce(grounded_event(F.col("event"), F.col("bound_body"), F.col("bound_at")), F.col("bound_at"))).otherwise(F.col("bound_at"))
    speaker = F.when(F.col("bound"), text.speaker_flag(F.col("bound_speaker"))).otherwise(F.when(F.col("untrusted"), F.lit(UNBOUND)))
    flags = F.concat(text.check_flags(F.col("fact"), F.col("transcript"), allowed), F.filter(F.array(speaker, F.when(F.col("importance").isNull(), F.lit(UNSCORED))), lambda x: x.isNotNull()))
    return rows.withColumn("flags", flags).select(
        "conversation_id", "window_no", "line_no", "supersedes", F.col("fact").alias("content"), F.lit("chat").alias("source"), F.lit(source_app).alias("origin_agent"), F.lit(source_app).alias("source_app"),
        event.alias("event_date"), F.when(F.size("flags") > 0, "low").otherwise("high").alias("confidence"), "importance", F.col("bound_id").alias("source_message_id"),
        F.when(F.size("flags") > 0, F.concat(F.array_join("flags", "; "), F.lit(" — review before trusting"))).alias("quarantine_reason"),
    )


def retry_scores(parsed: DataFrame, ask: Callable[[str], int | None]) -> DataFrame:
    """One corrective call for each line without a score; what it gives is clamped to 1 to 9."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            given = [ask(x) for x in f["fact"]]
            yield f.assign(importance=pd.array([None if g is None else min(9, max(1, g)) for g in given], dtype="Int32"))

    return parsed.where("importance is not null").unionByName(parsed.where("importance is null").mapInPandas(run, parsed.schema))


def supersede_actions(new: DataFrame, facts: DataFrame) -> DataFrame:
    """id, old_id, action (apply, refuse, defer) for new(id, event_date, quarantined, supersedes) against offered valid facts; settle.settle orders them."""
    wanted = new.select("id", "event_date", "quarantined", F.posexplode("supersedes").alias("pos", "old_id"))
    old = facts.select(F.col("id").alias("old_id"), F.col("event_date").alias("old_date"))
    return wanted.join(old, "old_id").select("id", "pos", "old_id", claim_action(F.col("quarantined"), F.col("old_date"), F.col("event_date")).alias("action"))


def numbered_messages(messages: DataFrame) -> DataFrame:
    """msg_no within a conversation by id."""
    return messages.withColumn("msg_no", F.row_number().over(Window.partitionBy("conversation_id").orderBy("id")))
