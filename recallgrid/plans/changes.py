"""Queries over state transitions: each returns the table, or the part of it, after the change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import NOW, TRUSTED_APPS
from ..operators import episodes, facts, mining, models
from .registry import Views, add
from .scans import IDS, id_rows, placed_windows
from .sqltext import FILE_BODIES, windowed

HELD = [4, 15, 26, 37, 48, 3]
HELD_SQL = ", ".join(map(str, HELD))
STATE = ["id", "quarantined_at", "quarantine_reason", "review_dismissed_at"]
GONE = list(range(1, 400, 30))


def candidates(v: Views) -> DataFrame:
    """Facts offered to the write gate, from the claims."""
    k = F.col("id")
    origin = F.when(k % 4 == 0, "user").when(k % 4 == 1, "mcp:tool").when(k % 4 == 2, "chat-app").otherwise("")
    return v("v_claims").select(
        F.when(k % 31 == 0, F.lit(" tiny ")).otherwise(F.concat(F.lit("  "), "fact", F.lit("  \n"))).alias("content"), F.lit("chat").alias("source"), origin.alias("origin_agent"), F.when(k % 3 != 0, F.lit("chat-app")).alias("source_app"),
        F.when(k % 5 == 0, F.lit(0.0)).otherwise(F.col("created_at")).alias("event_date"), F.lit("high").alias("confidence"), (k % 10).cast("int").alias("importance"), F.col("customer_id").alias("conversation_id"), k.alias("source_message_id"),
        F.when(k % 11 == 0, F.lit("asked for review")).alias("quarantine_reason"),
    )


add(
    "dml_add_fact",
    lambda v: facts.gated(candidates(v), TRUSTED_APPS, NOW).select("source_message_id", "content", "origin_agent", "event_date", "confidence", "importance", "quarantined_at", "quarantine_reason"),
    f"""SELECT id AS source_message_id, trim(fact) AS content, origin AS origin_agent, CASE WHEN id % 5 = 0 THEN {NOW}e0 ELSE created_at END AS event_date, CASE WHEN bad THEN 'low' ELSE 'high' END AS confidence,
      CAST(id % 10 AS INT) AS importance, CASE WHEN bad OR id % 11 = 0 THEN {NOW}e0 END AS quarantined_at,
      CASE WHEN id % 11 = 0 THEN 'asked for review' WHEN bad THEN 'external write (' || origin || ') — held for review before becoming canon' END AS quarantine_reason
    FROM (SELECT *, id % 11 <> 0 AND NOT (origin = 'user' OR (origin NOT LIKE 'mcp:%' AND id % 3 <> 0)) AS bad
      FROM (SELECT *, CASE id % 4 WHEN 1 THEN 'mcp:tool' WHEN 2 THEN 'chat-app' ELSE 'user' END AS origin FROM v_claims) x) y WHERE id % 31 <> 0""",
)
add(
    "dml_add_fact_unfit", lambda v: facts.unfit(candidates(v)).select("source_message_id", "chars", "reason"),
    """SELECT id AS source_message_id, length(c) AS chars, CASE WHEN length(c) < 8 THEN 'shorter than 8 characters' ELSE 'longer than 10000 characters' END AS reason
    FROM (SELECT id, CASE WHEN id % 31 = 0 THEN 'tiny' ELSE trim(fact) END AS c FROM v_claims) x WHERE length(c) NOT BETWEEN 8 AND 10000""",
)


def _offered(v: Views) -> DataFrame:
    here = F.when(F.col("id") % 8 == 1, F.col("conversation_id")).otherwise(F.col("conversation_id") + 1)
    return v("v_facts").select("id", here.alias("conversation_id"), "content_hash")


add(
    "dml_dedupe_conv",
    lambda v: facts.dedupe_in_conversation(_offered(v), v("v_facts"), "id").select("id", "existing_id", "repeat"),
    """WITH o AS (SELECT id, CASE WHEN id % 8 = 1 THEN conversation_id ELSE conversation_id + 1 END AS conversation_id, content_hash FROM v_facts),
    known AS (SELECT conversation_id, content_hash, min(id) AS existing_id FROM v_facts WHERE invalidated_at IS NULL GROUP BY conversation_id, content_hash)
    SELECT id, existing_id, row_number() OVER (PARTITION BY o.conversation_id, o.content_hash ORDER BY id) > 1 AS "repeat" FROM o LEFT JOIN known USING (conversation_id, content_hash)""",
)


def _patches(v: Views) -> DataFrame:
    k = F.col("id")
    return v("v_facts").where("id % 6 = 0").select(
        "id", F.when(k % 12 == 0, F.concat(F.lit("  Patched \t fact  "), k.cast("string"), F.lit(" "))).alias("content"), F.when(k % 9 == 0, F.lit(1700000000.0)).alias("event_date"),
        F.when(k % 24 == 0, F.lit("medium")).alias("confidence"), F.when(k % 18 == 0, F.lit(99)).when(k % 18 == 6, F.lit(-2)).alias("importance"),
    )


add(
    "dml_update_fact",
    lambda v: facts.patch(v("v_facts"), _patches(v)).select("id", "content", "content_hash", F.col("embedding").isNull().alias("no_vector"), "event_date", "confidence", "importance"),
    """SELECT id, CASE WHEN id % 12 = 0 THEN 'Patched fact ' || id ELSE content END AS content, CASE WHEN id % 12 = 0 THEN substring(sha256('patched fact ' || id), 1, 16) ELSE content_hash END AS content_hash,
      id % 12 = 0 OR embedding IS NULL AS no_vector, CASE WHEN id % 18 = 0 THEN 1700000000e0 ELSE event_date END AS event_date, CASE WHEN id % 24 = 0 THEN 'medium' ELSE confidence END AS confidence,
      CASE WHEN id % 18 = 0 THEN 10 WHEN id % 18 = 6 THEN 1 ELSE importance END AS importance FROM v_facts""",
)


def _pairs(v: Views) -> DataFrame:
    old = v("v_facts").where("id % 9 = 0").select(F.col("id").alias("old_id"))
    return old.select("old_id", F.explode(F.array(F.struct((F.col("old_id") + 2).alias("new_id"), F.lit(1).alias("pos")), F.struct((F.col("old_id") + 1).alias("new_id"), F.lit(0).alias("pos")))).alias("p")).select("old_id", "p.new_id", "p.pos")


add(
    "dml_supersede", lambda v: facts.supersede(v("v_facts"), _pairs(v), NOW).select("id", "invalidated_at", "superseded_by"),
    f"SELECT id, CASE WHEN id % 9 = 0 AND invalidated_at IS NULL THEN {NOW}e0 ELSE invalidated_at END AS invalidated_at, CASE WHEN id % 9 = 0 AND invalidated_at IS NULL THEN id + 1 ELSE superseded_by END AS superseded_by FROM v_facts",
)
add(
    "dml_quarantine", lambda v: facts.quarantine(v("v_facts"), HELD, "by hand", NOW).select(*STATE),
    f"""SELECT id, coalesce(quarantined_at, CASE WHEN id IN ({HELD_SQL}) THEN {NOW}e0 END) AS quarantined_at,
      CASE WHEN quarantined_at IS NULL AND id IN ({HELD_SQL}) THEN 'by hand' ELSE quarantine_reason END AS quarantine_reason, review_dismissed_at FROM v_facts""",
)
add(
    "dml_quar_many", lambda v: facts.quarantine_report(v("v_facts"), id_rows(v, [*IDS, 4])),
    """SELECT t.id, t.pos, CASE WHEN f.id IS NOT NULL THEN 'quarantined' ELSE 'skipped' END AS outcome FROM (VALUES (5, 0), (3, 1), (900000, 2), (8, 3), (21, 5), (4, 6)) t(id, pos)
    LEFT JOIN v_facts f ON f.id = t.id AND f.quarantined_at IS NULL""",
)
add(
    "dml_approve", lambda v: facts.approve(v("v_facts"), HELD).select(*STATE),
    f"""SELECT id, CASE WHEN id NOT IN ({HELD_SQL}) THEN quarantined_at END AS quarantined_at, CASE WHEN id NOT IN ({HELD_SQL}) THEN quarantine_reason END AS quarantine_reason,
      CASE WHEN id NOT IN ({HELD_SQL}) THEN review_dismissed_at END AS review_dismissed_at FROM v_facts""",
)
add(
    "dml_dismiss", lambda v: facts.dismiss(v("v_facts"), HELD, NOW).select(*STATE),
    f"SELECT id, quarantined_at, quarantine_reason, CASE WHEN id IN ({HELD_SQL}) AND quarantined_at IS NOT NULL THEN {NOW}e0 ELSE review_dismissed_at END AS review_dismissed_at FROM v_facts",
)
add(
    "dml_dismiss_all", lambda v: facts.dismiss(v("v_facts"), None, NOW).select(*STATE),
    f"SELECT id, quarantined_at, quarantine_reason, CASE WHEN quarantined_at IS NOT NULL THEN coalesce(review_dismissed_at, {NOW}e0) ELSE review_dismissed_at END AS review_dismissed_at FROM v_facts",
)
add("dml_hard_delete", lambda v: facts.hard_delete(v("v_facts"), HELD).select("id", "content_hash"), f"SELECT id, content_hash FROM v_facts WHERE id NOT IN ({HELD_SQL})")
add(
    "dml_att_delete", lambda v: episodes.delete_attachment(v("v_attachments"), GONE)[1],
    f"SELECT DISTINCT stored_name FROM v_attachments WHERE id IN ({', '.join(map(str, GONE))}) AND stored_name NOT IN (SELECT stored_name FROM v_attachments WHERE id NOT IN ({', '.join(map(str, GONE))}))",
)


def _posted_messages(v: Views) -> DataFrame:
    """Every message, some of them sent twice."""
    m = v("v_messages")
    return m.withColumn("sent", F.col("id")).unionByName(m.where("id % 5 = 0").withColumn("sent", F.col("id") + 10_000_000))


add(
    "dml_ingest_msg", lambda v: episodes.ingest_report(_posted_messages(v), v("v_messages").where("id % 3 = 0"), ["conversation_id", "external_id"], "sent"),
    "SELECT count(*) FILTER (id % 3 <> 0) AS ingested, count(*) FILTER (id % 3 = 0) + count(*) FILTER (id % 5 = 0) AS skipped FROM v_messages",
)
add(
    "dml_add_att", lambda v: episodes.new_rows(v("v_attachments"), v("v_attachments").where("id % 40 = 1"), ["conversation_id", "message_external_id", "sha256"], "id").select("id", "conversation_id", "sha256"),
    """SELECT id, conversation_id, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, message_external_id, sha256 ORDER BY id) AS nth FROM v_attachments) a WHERE nth = 1
      AND NOT EXISTS (SELECT 1 FROM v_attachments b WHERE b.id % 40 = 1 AND b.conversation_id = a.conversation_id AND b.message_external_id = a.message_external_id AND b.sha256 = a.sha256)""",
)


def _titles() -> list:
    """A conversation's titles in a batch: the last that isn't empty counts, not the greatest."""
    named = lambda word: F.when(F.col("id") % 2 == 0, F.concat(F.lit(word), F.col("id").cast("string"))).otherwise("")
    return [named("zzz "), named("renamed "), F.lit("")]


def _conversation_batch(v: Views) -> DataFrame:
    return v("v_conversations").where("id % 3 <> 1").select("source_app", "external_id", F.explode(F.array(*(F.struct((F.col("id") * 4 + k).alias("pos"), t.alias("title")) for k, t in enumerate(_titles())))).alias("x")).select("source_app", "external_id", "x.pos", "x.title")


add(
    "dml_conv_upsert", lambda v: episodes.upsert_conversations(v("v_conversations").where("id % 3 <> 0"), _conversation_batch(v), NOW, "pos"),
    f"""SELECT CASE WHEN id % 3 <> 0 THEN id ELSE (SELECT max(id) FROM v_conversations WHERE id % 3 <> 0) + row_number() OVER (PARTITION BY id % 3 = 0 ORDER BY id) END AS id,
      source_app, external_id, CASE WHEN id % 3 <> 1 AND id % 2 = 0 THEN 'renamed ' || id WHEN id % 3 <> 0 THEN title ELSE '' END AS title, CASE WHEN id % 3 <> 0 THEN mined_upto ELSE 0 END AS mined_upto,
      CASE WHEN id % 3 <> 0 THEN created_at ELSE {NOW}e0 END AS created_at FROM v_conversations""",
)
add(
    "dml_caption", lambda v: models.caption_pending(v("v_attachments"), v("v_captions"), lambda name, mime: f"picture {name[:8]}", "model-b", NOW),
    f"""SELECT id AS attachment_id, '[Image description (auto-generated by model-b): picture ' || substring(stored_name, 1, 8) || ']' AS caption, 'model-b' AS model, {NOW}e0 AS created_at
    FROM v_attachments WHERE mime IN ('image/jpeg', 'image/png', 'image/gif', 'image/webp') AND size <= 4500000 AND extracted_text = '' AND id NOT IN (SELECT attachment_id FROM v_captions)""",
)


def _replies(v: Views) -> DataFrame:
    """Scores as a model writes them: some twice, some out of range, with chatter between."""
    k = F.col("id").cast("string")
    text = F.concat(k, F.lit("="), (F.col("id") % 14).cast("string"), F.lit("\nhere you are\n["), k, F.lit("]: "), F.when(F.col("id") % 3 == 0, (F.col("id") % 5).cast("string")).otherwise("none"))
    return v("v_facts").select(F.col("id").alias("pos"), text.alias("text"))


SCORES = "SELECT id, CASE WHEN id % 3 = 0 THEN least(9, greatest(1, id % 5)) ELSE least(9, greatest(1, id % 14)) END AS score FROM v_facts"
add("snk_batch_scores", lambda v: facts.parse_scores(_replies(v)), SCORES)
add(
    "dml_imp_fill", lambda v: facts.fill_importance(v("v_facts"), facts.parse_scores(_replies(v))).select("id", "importance"),
    f"SELECT id, coalesce(importance, score) AS importance FROM v_facts JOIN ({SCORES}) s USING (id)",
)
add(
    "dml_emb_fill", lambda v: models.fill_embeddings(v("v_facts"), lambda texts: [[float(len(t))] * 3 for t in texts]).select("id", F.size("embedding").alias("dims")),
    "SELECT id, CASE WHEN embedding IS NULL THEN 3 ELSE len(embedding) END AS dims FROM v_facts",
)
add("dml_advance", lambda v: mining.watermarks(mining.window_facts(placed_windows(v), "Alex")), "SELECT m.conversation_id AS id, max(m.id) AS mined_upto FROM v_messages m JOIN v_conversations c ON c.id = m.conversation_id WHERE m.id > c.mined_upto GROUP BY m.conversation_id")
add(
    "dml_setting", lambda v: episodes.latest_settings(v("v_access_log").select(F.col("id").alias("seq"), F.concat("origin", F.lit("/"), (F.col("id") % 100).cast("string")).alias("key"), "kind").withColumnRenamed("kind", "value")),
    "SELECT key, arg_max(kind, id) AS value FROM (SELECT id, origin || '/' || (id % 100) AS key, kind FROM v_access_log) x GROUP BY key",
)
add(
    "snk_access", lambda v: episodes.access_rows(v("v_access_log")).select("id", "ts", "kind", "origin", "query", "result_count", F.get("result_ids", 0)["fact_id"].alias("first_id")),
    "SELECT id, ts, kind, origin, substring(query, 1, 500) AS query, coalesce(len(result_ids), 0) AS result_count, result_ids[1] AS first_id FROM v_access_log",
)
add(
    "txt_body", lambda v: placed_windows(v).select("id", "view_len", F.sha2("body", 256).alias("body_sha")),
    f"WITH RECURSIVE {windowed(120, 350000)} SELECT id, view_len, sha256(body) AS body_sha FROM placed",
)
add(
    "jon_att_msg", lambda v: episodes.attachment_ids_by_message(v("v_attachments")).select("conversation_id", "external_id", F.size("ids").alias("n"), F.col("ids").cast("string").alias("ids")),
    f"SELECT conversation_id, message_external_id AS external_id, count(*) AS n, '[' || string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id) || ']' AS ids FROM {FILE_BODIES} x GROUP BY conversation_id, message_external_id",
)
