"""Queries over scans: sources, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..fixtures import NOW, QUERY, TRUSTED_APPS
from ..functions import scoring
from ..operators import episodes, facts, mining, recall, summary, viz
from ..sources import readers
from .registry import Views, add, query_vector
from .sqltext import DAY, FACT, FACT_COLUMNS, KIND, SCORED, SPEAKER, STATUS, TAG, TS, VALID, windowed

SINCE = 1705300000.0
IDS = [5, 3, 900_000, 8, 3, 21]


def placed_windows(v: Views, most: int = episodes.WINDOW_MESSAGES, chars: int = episodes.WINDOW_CHARS) -> DataFrame:
    """The unmined messages in their mining windows."""
    files = episodes.attachments_by_message(v("v_attachments"), v("v_captions"))
    return mining.windows(episodes.with_bodies(episodes.unmined(v("v_messages"), v("v_conversations")), files), most, chars)


def id_rows(v: Views, ids: list[int]) -> DataFrame:
    return v("v_facts").sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, pos int")


def _requests(v: Views) -> DataFrame:
    """Conversations as requests of at most MAX_MESSAGES messages; first is the position of a request's first one.

    Messages are counted by ranges of ids, so that no group grows with a conversation.
    """
    messages = v("v_messages").withColumn("range", F.floor(F.col("id") / readers.MAX_MESSAGES))
    sizes = messages.groupBy("conversation_id", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conversation_id").orderBy("range")) - F.col("n")
    nth = F.col("before") + F.row_number().over(Window.partitionBy("conversation_id", "range").orderBy("id")) - 1
    placed = messages.join(sizes.withColumn("before", before).drop("n"), ["conversation_id", "range"]).withColumn("block", F.floor(nth / readers.MAX_MESSAGES))
    none = F.lit(None).cast("array<struct<filename:string,mime:string,data_b64:string>>").alias("attachments")
    said = F.struct("id", "external_id", "speaker", "content", F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), none)
    grouped = placed.groupBy("conversation_id", "block").agg(F.sort_array(F.collect_list(said)).alias("messages"))
    homes = v("v_conversations").select(F.col("id").alias("conversation_id"), "source_app", "external_id", "title")
    return grouped.join(homes, "conversation_id").select("source_app", F.col("external_id").alias("conversation_id"), "title", (F.col("block") * readers.MAX_MESSAGES).alias("first"), "messages")


def _posted(v: Views) -> DataFrame:
    data = F.when(F.col("id") % 30 == 11, F.lit("no base64 *")).otherwise(F.base64(F.col("extracted_text").cast("binary")))
    file = F.struct("filename", "mime", data.alias("data_b64"))
    return v("v_attachments").select(F.lit("chat-app").alias("source_app"), F.col("conversation_id").cast("string").alias("conversation_external_id"), F.col("message_external_id").alias("external_id"), F.array(file).alias("attachments"))


add("src_scan_facts", lambda v: v("v_facts").where(schema.valid()).select(*FACT_COLUMNS), f"SELECT {FACT} FROM v_facts WHERE {VALID}")
add("src_scan_emb", lambda v: viz.embedded(v("v_facts")).select("id", F.size("embedding").alias("dims")), "SELECT id, len(embedding) AS dims FROM v_facts WHERE embedding IS NOT NULL ORDER BY id DESC LIMIT 2500")
add("src_point", lambda v: v("v_facts").where("id = 7").select(*FACT_COLUMNS), f"SELECT {FACT} FROM v_facts WHERE id = 7")
add("src_msgs_after", lambda v: episodes.messages_after(v("v_messages"), 13, 12002).select("id", "external_id", "speaker", "content", "created_at"), "SELECT id, external_id, speaker, content, created_at FROM v_messages WHERE conversation_id = 13 AND id > 12002")
add(
    "src_ingest_json",
    lambda v: readers.request_messages(_requests(v)).select("source_app", "conversation_external_id", "pos", "external_id", "speaker", "created_at", F.length("content").alias("chars")),
    """SELECT c.source_app, c.external_id AS conversation_external_id, row_number() OVER (PARTITION BY m.conversation_id ORDER BY m.id) - 1 AS pos, m.external_id, speaker, m.created_at, length(content) AS chars
    FROM v_messages m JOIN v_conversations c ON c.id = m.conversation_id""",
)
add(
    "src_text",
    lambda v: v("v_attachments").select("id", readers.extract_text(F.col("extracted_text").cast("binary"), F.col("filename"), F.col("mime")).alias("t")).select("id", F.length("t").alias("chars"), F.sha2("t", 256).alias("sha")),
    "SELECT id, length(t) AS chars, sha256(t) AS sha FROM (SELECT id, CASE WHEN mime LIKE 'text/%' THEN extracted_text ELSE '' END AS t FROM v_attachments) x",
)
add(
    "src_b64",
    lambda v: readers.request_files(_posted(v)).select("message_external_id", "filename", "size", "sha256", "stored_name"),
    """SELECT message_external_id, filename, CAST(octet_length(encode(extracted_text)) AS BIGINT) AS size, sha256(extracted_text) AS sha256, sha256(extracted_text) || substring(filename, length(filename) - 3) AS stored_name
    FROM v_attachments WHERE id % 30 <> 11""",
)

add("prj_public", lambda v: facts.public(v("v_facts")).select("content", *FACT_COLUMNS), f"SELECT content, {FACT} FROM v_facts")
add("prj_prov_tag", lambda v: v("v_facts").select("id", facts.provenance_tag(F.col("origin_agent"), F.col("source")).alias("tag")), f"SELECT id, {TAG} AS tag FROM v_facts")
add(
    "prj_prov", lambda v: facts.provenance(v("v_facts"), id_rows(v, [5, 3, 900_000, 8])).select("pos", "id", "origin_agent", "source", "tag"),
    f"SELECT pos, f.id, origin_agent, source, {TAG} AS tag FROM (VALUES (0, 5), (1, 3), (2, 900000), (3, 8)) t(pos, id) JOIN v_facts f ON f.id = t.id",
)
add("prj_status", lambda v: v("v_facts").select("id", schema.status_label().alias("status")), f"SELECT id, {STATUS} AS status FROM v_facts")
add("prj_kind", lambda v: v("v_attachments").select("id", episodes.kind_of(F.col("mime"), F.col("extracted_text")).alias("kind")), f"SELECT id, {KIND} AS kind FROM v_attachments")
add(
    "prj_preview", lambda v: v("v_attachments").select("id", F.substring("extracted_text", 1, episodes.PREVIEW_CHARS).alias("preview"), (F.length("extracted_text") > episodes.PREVIEW_CHARS).alias("truncated")),
    "SELECT id, substring(extracted_text, 1, 4000) AS preview, length(extracted_text) > 4000 AS truncated FROM v_attachments",
)
add(
    "prj_fmt_fact", lambda v: v("v_facts").select("id", facts.fact_line().alias("line")),
    f"""SELECT id, '[' || {DAY(TS)} || CASE WHEN confidence = 'low' THEN '?' ELSE '' END || ' ·' || origin_agent || '] ' || content
      || CASE WHEN invalidated_at IS NOT NULL THEN ' [SUPERSEDED ' || {DAY("invalidated_at")} || ' — historical, no longer current]' ELSE '' END AS line FROM v_facts""",
)
add(
    "prj_fmt_admin", lambda v: v("v_facts").select("id", facts.admin_line().alias("line")),
    f"SELECT id, '[id=' || id || ' · ' || {STATUS} || ' · event ' || {DAY('event_date')} || ' · origin ' || origin_agent || '] ' || content AS line FROM v_facts",
)
add(
    "prj_fmt_hit",
    lambda v: v("v_messages").join(v("v_conversations").select(F.col("id").alias("conversation_id"), "title"), "conversation_id").select("id", F.concat(F.lit("["), scoring.day_of(F.col("created_at")), F.lit('] "'), "title", F.lit('" — '), "speaker", F.lit(": "), "content").alias("line")),
    f"SELECT m.id, '[' || {DAY('m.created_at')} || '] \"' || title || '\" — ' || speaker || ': ' || content AS line FROM v_messages m JOIN v_conversations c ON c.id = m.conversation_id",
)
add(
    "prj_summary_hdr", lambda v: v("v_facts").select("id", summary.with_header(F.when(F.col("id") % 4 != 0, F.col("source")), F.col("invalidated_at")).alias("summary")),
    """SELECT id, CASE WHEN id % 4 = 0 THEN 'No memory summary yet.' ELSE 'Profile summary generated_at: ' || coalesce(strftime(make_timestamp(CAST(invalidated_at AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ'), 'unknown')
      || chr(10) || 'For time-sensitive or active-thread status, verify with recall.' || chr(10) || chr(10) || source END AS summary FROM v_facts""",
)
add(
    "prj_summary_line", lambda v: v("v_facts").select("id", facts.summary_line().alias("line")),
    f"SELECT id, '- [' || id || ' · ' || {DAY(TS)} || ' · ' || {TAG} || '] ' || content AS line FROM v_facts",
)
add(
    "prj_ledger_line", lambda v: facts.block(v("v_facts").where(schema.valid()).orderBy(F.col("id").desc()).limit(250), F.concat(F.lit("- ["), F.col("id").cast("string"), F.lit("] "), F.col("content")), [-F.col("id")], "(empty)"),
    f"SELECT coalesce(string_agg('- [' || id || '] ' || content, chr(10) ORDER BY id DESC), '(empty)') AS block FROM (SELECT * FROM v_facts WHERE {VALID} ORDER BY id DESC LIMIT 250) x",
)


def versions(v: Views) -> DataFrame:
    """Summary versions for listings: one for each caption."""
    return v("v_captions").select(F.col("attachment_id").alias("id"), F.col("created_at").alias("generated_at"), F.col("caption").alias("content"), F.array("attachment_id").alias("source_fact_ids"), F.size(F.split("caption", " ")).alias("word_count"), F.lit(800).alias("word_budget"), "model", F.lit(None).cast("long").alias("restored_from"))


add(
    "prj_version_meta", lambda v: episodes.version_meta(versions(v)).drop("source_fact_ids"),
    "SELECT attachment_id AS id, created_at AS generated_at, len(string_split(caption, ' ')) AS word_count, 800 AS word_budget, model, CAST(NULL AS BIGINT) AS restored_from FROM v_captions",
)
add(
    "prj_lifecycle", lambda v: viz.lifecycle(v("v_facts")),
    f"SELECT id, round(nullif(created_at, 0), 1) AS c, round(nullif(invalidated_at, 0), 1) AS iv, round(nullif(quarantined_at, 0), 1) AS qt, round({TS}, 1) AS ed FROM v_facts",
)
add(
    "prj_health", lambda v: facts.health(v("v_facts")),
    f"""SELECT count(*) AS total, count(*) FILTER ({VALID}) AS current, count(*) FILTER (invalidated_at IS NOT NULL) AS superseded, count(*) FILTER (quarantined_at IS NOT NULL) AS quarantined,
      count(*) FILTER (quarantined_at IS NOT NULL AND review_dismissed_at IS NULL) AS pending_review FROM v_facts""",
)


def _by_status(v: Views) -> DataFrame:
    """Each state's rows; the last word is none, so it filters nothing."""
    out = None
    for s in ("valid", "superseded", "quarantined", "anything"):
        rows = facts.with_status(v("v_facts"), s).select("id", F.lit(s).alias("asked"))
        out = rows if out is None else out.unionByName(rows)
    return out


add(
    "flt_status", _by_status,
    f"""SELECT id, 'valid' AS asked FROM v_facts WHERE {VALID} UNION ALL SELECT id, 'superseded' FROM v_facts WHERE invalidated_at IS NOT NULL
    UNION ALL SELECT id, 'quarantined' FROM v_facts WHERE quarantined_at IS NOT NULL UNION ALL SELECT id, 'anything' FROM v_facts""",
)
add("flt_idq", lambda v: facts.list_facts(v("v_facts"), "all", "#12, 34  56", 2).select(*FACT_COLUMNS), f"SELECT {FACT} FROM v_facts WHERE id IN (12, 34, 56)")
add("flt_like", lambda v: facts.list_facts(v("v_facts"), "valid", "t_o%x", 100).select(*FACT_COLUMNS), f"SELECT {FACT} FROM v_facts WHERE {VALID} AND content ILIKE '%t_o%x%' ORDER BY id DESC LIMIT 100")
add("flt_review", lambda v: facts.review_queue(v("v_facts"), "The").select("id", "quarantine_reason"), "SELECT id, quarantine_reason FROM v_facts WHERE quarantined_at IS NOT NULL AND review_dismissed_at IS NULL AND contains(lower(content), 'the')")
add(
    "flt_candidate", lambda v: recall.scored(v("v_facts"), QUERY, query_vector(v), NOW).where("cand").select("id", "kw", F.round("sem", 4).alias("sem"), F.round("score", 4).alias("score")),
    f"WITH {SCORED} SELECT id, kw, round(sem, 4) AS sem, round(score, 4) AS score FROM scored WHERE cand",
)
add("flt_pending_img", lambda v: episodes.uncaptioned(v("v_attachments"), v("v_captions")).select("id", "filename", "mime"), "SELECT id, filename, mime FROM v_attachments WHERE mime LIKE 'image/%' AND coalesce(extracted_text, '') = '' AND id NOT IN (SELECT attachment_id FROM v_captions)")
add("flt_captionable", lambda v: episodes.captionable(v("v_attachments")).select("id", "mime", "size"), "SELECT id, mime, size FROM v_attachments WHERE mime IN ('image/jpeg', 'image/png', 'image/gif', 'image/webp') AND size <= 4500000")
add("flt_pin_cand", lambda v: facts.pin_candidates(v("v_facts")).select("id", "importance"), f"SELECT id, importance FROM v_facts WHERE {VALID} AND importance BETWEEN 7 AND 9")
add("flt_unscored", lambda v: v("v_facts").where("importance is null").select("id", "content_hash"), "SELECT id, content_hash FROM v_facts WHERE importance IS NULL")
add("flt_events_since", lambda v: episodes.events_since(v("v_access_log"), SINCE).select("id", "ts", "kind", "origin", "query"), f"SELECT id, ts, kind, origin, substring(query, 1, 200) AS query FROM v_access_log WHERE ts > {SINCE} ORDER BY ts, id LIMIT 200")
add(
    "flt_trust", lambda v: v("v_facts").select("id", facts.trusted(F.col("origin_agent"), F.when(F.col("id") % 2 == 0, F.lit("chat-app")), TRUSTED_APPS).alias("trusted")),
    "SELECT id, CASE WHEN origin_agent = 'user' THEN true WHEN origin_agent LIKE 'mcp:%' THEN false ELSE id % 2 = 0 END AS trusted FROM v_facts",
)
add(
    "flt_human_window", lambda v: mining.window_facts(placed_windows(v, 3, 2000), "Alex").select("conversation_id", "window_no", "n_messages", "mined", "untrusted"),
    f"""WITH RECURSIVE {windowed(3, 2000)} SELECT conversation_id, window_no, count(*) AS n_messages, bool_or({SPEAKER} IN ('owner', 'guest', 'guest-unknown')) AS mined,
      bool_or({SPEAKER} IN ('guest', 'guest-unknown', 'unrecognised')) AS untrusted FROM placed GROUP BY conversation_id, window_no""",
)
