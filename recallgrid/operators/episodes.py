"""Conversations, messages, attachments, captions, access log and settings: listings and idempotent ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from .facts import numbered

QUERY_CHARS, SERVED_CHARS, PREVIEW_CHARS, PREVIEW_FACTS = 500, 200, 4000, 8
MESSAGE_CHARS, WINDOW_MESSAGES, WINDOW_CHARS = 20_000, 120, 350_000
FILE_RANGE = 10_000
CAPTION_TYPES, CAPTION_BYTES = ["image/jpeg", "image/png", "image/gif", "image/webp"], 4_500_000
CUT = " … [truncated]"


def new_rows(batch: DataFrame, table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert-or-ignore: rows of batch whose keys are new, the first of each key."""
    first = batch.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("nth = 1").drop("nth")
    return first.join(table.select(*keys).distinct(), keys, "left_anti")


def ingest_report(batch: DataFrame, table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """ingested and skipped counts of a batch."""
    new = new_rows(batch, table, keys, order).agg(F.count("*").alias("ingested"))
    return batch.agg(F.count("*").alias("total")).crossJoin(new).select("ingested", (F.col("total") - F.col("ingested")).alias("skipped"))  # one row each


def upsert_conversations(old: DataFrame, batch: DataFrame, now: float, order: str) -> DataFrame:
    """Conversations by (source_app, external_id); the batch's last title that isn't empty replaces the old one.

    New ones get ids after the largest, in the order in which the batch names them first.
    """
    key = ["source_app", "external_id"]
    b = batch.groupBy(*key).agg(F.max_by("title", F.when(F.col("title") != "", F.col(order))).alias("new_title"), F.min(order).alias("first"))
    last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = numbered(b.join(old.select(*key), key, "left_anti").select(*key, "first"), ["first", *key], last + 1).select(*key, F.col("id").alias("new_id"))
    joined = old.join(b, key, "full_outer").join(new, key, "left").withColumn("id", F.coalesce("id", "new_id"))
    title = F.coalesce(F.when(F.col("new_title") != "", F.col("new_title")), F.col("title"), F.lit(""))
    return joined.select("id", "source_app", "external_id", title.alias("title"), F.coalesce("mined_upto", F.lit(0)).cast("long").alias("mined_upto"), F.coalesce("created_at", F.lit(float(now))).alias("created_at"))


def messages_after(messages: DataFrame, conversation_id: int, after: int = 0) -> DataFrame:
    return messages.where((F.col("conversation_id") == conversation_id) & (F.col("id") > after)).orderBy("id")


def unmined(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Messages above their conversation's watermark."""
    marks = conversations.select(F.col("id").alias("conversation_id"), "mined_upto")
    return messages.join(marks, "conversation_id").where("id > mined_upto").drop("mined_upto")


def list_attachments(attachments: DataFrame, conversations: DataFrame, limit: int = 200) -> DataFrame:
    homes = conversations.select(F.col("id").alias("conversation_id"), "title", "source_app")
    return attachments.orderBy(F.col("id").desc()).limit(limit).join(homes, "conversation_id").drop("extracted_text").orderBy(F.col("id").desc())


def kind_of(mime: Column, text: Column) -> Column:
    return F.when(mime.startswith("image/"), "image").when(text != "", "text").otherwise("binary")


def preview(attachments: DataFrame, conversations: DataFrame, messages: DataFrame, facts: DataFrame) -> DataFrame:
    """Each attachment with its text's start, its message and the newest valid facts of its conversation (as ids)."""
    homes = conversations.select(F.col("id").alias("conversation_id"), "title")
    said = messages.select("conversation_id", F.col("external_id").alias("message_external_id"), F.col("id").alias("message_id"))
    nth = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.col("id").desc()))
    newest = facts.where(schema.valid()).withColumn("nth", nth).where(F.col("nth") <= PREVIEW_FACTS).groupBy("conversation_id").agg(F.reverse(F.sort_array(F.collect_list("id"))).alias("fact_ids"))
    out = attachments.join(homes, "conversation_id").join(said, ["conversation_id", "message_external_id"], "left").join(newest, "conversation_id", "left")
    return out.select("id", "title", "message_id", "fact_ids", kind_of(F.col("mime"), F.col("extracted_text")).alias("kind"), F.substring("extracted_text", 1, PREVIEW_CHARS).alias("preview"), (F.length("extracted_text") > PREVIEW_CHARS).alias("truncated"))


def delete_attachment(attachments: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """The table without ids, and the stored names that no row keeps."""
    kept = attachments.where(~F.col("id").isin(ids))
    gone = attachments.where(F.col("id").isin(ids)).select("stored_name").distinct()
    return kept, gone.join(kept.select("stored_name"), "stored_name", "left_anti")


def uncaptioned(attachments: DataFrame, captions: DataFrame) -> DataFrame:
    """Images without text that have no caption yet."""
    images = attachments.where(F.col("mime").startswith("image/") & (F.coalesce("extracted_text", F.lit("")) == ""))
    return images.join(captions.select(F.col("attachment_id").alias("id")), "id", "left_anti")


def captionable(attachments: DataFrame) -> DataFrame:
    return attachments.where(F.col("mime").isin(CAPTION_TYPES) & (F.col("size") <= CAPTION_BYTES))


def caption_marker(model: Column, text: Column) -> Column:
    return F.concat(F.lit("[Image description (auto-generated by "), model, F.lit("): "), text, F.lit("]"))


def attachment_ids_by_message(attachments: DataFrame) -> DataFrame:
    """conversation_id, external_id, ids of all files in order."""
    return attachments.groupBy("conversation_id", F.col("message_external_id").alias("external_id")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def files_by_message(attachments: DataFrame) -> DataFrame:
    """conversation_id, external_id, files array<struct<id, filename, size>> of all files in order, without their texts."""
    return attachments.groupBy("conversation_id", F.col("message_external_id").alias("external_id")).agg(F.sort_array(F.collect_list(F.struct("id", "filename", "size"))).alias("files"))


def attachments_by_message(attachments: DataFrame, captions: DataFrame) -> DataFrame:
    """conversation_id, external_id, files array<struct<id, filename, body>> by id, chars of all these bodies: what a message's body can show of its files.

    These are the files with text that start below MESSAGE_CHARS, each cut one character beyond that, so
    that with_bodies still sees that it cuts. Lengths are summed by ranges of ids.
    """
    from .search import attachment_text

    key = ["conversation_id", "external_id", "range"]
    files = attachment_text(attachments, captions).where("body <> ''").select("conversation_id", F.col("message_external_id").alias("external_id"), F.floor(F.col("id") / FILE_RANGE).alias("range"), "id", "filename", F.substring("body", 1, MESSAGE_CHARS + 1).alias("body")).withColumn("n", F.length("body"))
    rows = files.select(*key, "id", "n")  # no texts
    sums = rows.groupBy(*key).agg(F.sum("n").alias("in_range"))
    before = F.sum("in_range").over(Window.partitionBy(*key[:2]).orderBy("range")) - F.col("in_range")
    first = sums.withColumn("before", before).drop("in_range").where(F.col("before") < MESSAGE_CHARS)
    start = F.col("before") + F.sum("n").over(Window.partitionBy(*key).orderBy("id")) - F.col("n")
    kept = rows.join(first, key).withColumn("start", start).where(F.col("start") < MESSAGE_CHARS).select(*key[:2], "id")
    # of a file beyond the limit only its first texts move, to the message where they are needed
    shown = files.drop("range").join(kept, [*key[:2], "id"], "left_semi")
    return shown.groupBy(*key[:2]).agg(F.sort_array(F.collect_list(F.struct("id", "filename", "body"))).alias("files"), F.sum("n").cast("int").alias("chars"))


def with_bodies(messages: DataFrame, files: DataFrame) -> DataFrame:
    """messages with body (content and attachment texts, cut) and view_len (characters that count for a window).

    Where files(..., chars) tells how long the texts are, these and the contents move only if body is asked for.
    """
    joined = messages.withColumn("said", F.length("content")).join(files, ["conversation_id", "external_id"], "left")
    own = F.filter(F.coalesce("files", F.array().cast("array<struct<id:bigint,filename:string,body:string>>")), lambda f: f["body"] != "")
    added = F.array_join(F.transform(own, lambda f: F.concat(F.lit("\n[Attached file: "), f["filename"], F.lit("]\n"), f["body"])), "")
    body = F.concat(F.col("content"), added)
    size = F.col("said") + (F.coalesce("chars", F.lit(0)) if "chars" in files.columns else F.aggregate(own, F.lit(0), lambda a, f: a + F.length(f["body"])))
    cut = F.when(F.length(body) > MESSAGE_CHARS, F.concat(F.substring(body, 1, MESSAGE_CHARS), F.lit(CUT))).otherwise(body)
    return joined.withColumns({"body": cut, "view_len": F.least(size, F.lit(MESSAGE_CHARS))}).drop("files", "chars", "said")


def access_rows(events: DataFrame) -> DataFrame:
    """Log rows as they are stored: query cut, result ids with scores, count."""
    ids = F.coalesce("result_ids", F.array().cast("array<bigint>"))
    pairs = F.transform(ids, lambda i: F.struct(i.alias("fact_id"), F.lit(None).cast("double").alias("score")))
    return events.select("id", "ts", "kind", "origin", F.substring("query", 1, QUERY_CHARS).alias("query"), pairs.alias("result_ids"), F.size(ids).alias("result_count"))


def events_since(log: DataFrame, ts: float, limit: int = 200) -> DataFrame:
    return log.where(F.col("ts") > ts).orderBy("ts", "id").limit(limit).withColumn("query", F.substring("query", 1, SERVED_CHARS))


def tail(log: DataFrame, n: int) -> DataFrame:
    """The newest n, oldest first."""
    return log.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n).orderBy("ts", "id")


def latest_settings(changes: DataFrame) -> DataFrame:
    """key and value of changes(seq, key, value): the last of each key."""
    return changes.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def retained(snapshots: DataFrame, keep: int) -> DataFrame:
    """Names of snapshots(place, name) that stay: the newest keep of each place."""
    nth = F.row_number().over(Window.partitionBy("place").orderBy(F.col("name").desc()))
    return snapshots.withColumn("nth", nth).where(F.col("nth") <= keep).drop("nth")


def version_meta(versions: DataFrame) -> DataFrame:
    return versions.drop("content").orderBy(F.col("id").desc())
