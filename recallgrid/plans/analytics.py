"""Queries over full-text search, graph and vector analytics, and incremental mining."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import NOW, OWNER, QUERY
from ..operators import episodes, facts, index, mining, recall, search, summary, viz
from ..operators.tables import new_path, stored
from ..schema import DDL
from ..streaming import ingest, leases, sink, windows
from .registry import Views, add, query_vector
from .relations import PAIRS, POOL, RANKED
from .scans import placed_windows, versions
from .sqltext import IMP, LABEL, SPEAKER, VALID, WEIGHT, fold, windowed

WORDS = "the ththe tion"
PHRASES = [["the"], ["over", "the"], ["tion", "with"]]
TOKENS = r"list_filter(string_split_regex(strip_accents(lower(content)), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


_indexes: dict[tuple, index.Index] = {}


def _index(v: Views, name: str, texts: Callable[[], DataFrame], content: str) -> index.Index:
    """The index of a view's texts, made when it is first asked for and kept for the session."""
    key = (*v.place, name)
    if key not in _indexes or not _indexes[key].log.files.names("_log"):
        made = index.Index(v.spark, new_path(v.spark, f"index-{name}"))
        made.add(texts(), content, name, 0)
        _indexes[key] = made
    return _indexes[key]


def _said(v: Views) -> index.Index:
    return _index(v, "messages", lambda: v("v_messages"), "content")


def _held(v: Views) -> index.Index:
    return _index(v, "attachments", lambda: _files(v), "body")


def bm25_sql(docs: str, words: list[str]) -> str:
    """Scores of docs(id, content) by single words."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""WITH t AS (SELECT id, {TOKENS} AS ts FROM {docs}), l AS (SELECT id, len(ts) AS n FROM t), s AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
    tf AS (SELECT id, w, len(list_filter(ts, lambda x: x = w)) AS tf FROM t, (SELECT unnest([{listed}]) AS w) q WHERE list_contains(ts, w)),
    df AS (SELECT w, count(*) AS df FROM tf GROUP BY w)
    SELECT id, sum(greatest(ln((docs - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * n / mean))) AS score FROM tf JOIN df USING (w) JOIN l USING (id), s GROUP BY id"""


add(
    "fts_token", lambda v: search.postings(v("v_messages"), "content").select("token", "id", F.size("positions").alias("tf")),
    f"SELECT token, id, count(*) AS tf FROM (SELECT id, unnest({TOKENS}) AS token FROM v_messages) x GROUP BY token, id",
)
add(
    "fts_match", lambda v: _said(v).matches(PHRASES).select("phrase_no", "id"),
    " UNION ALL ".join(f"SELECT {k} AS phrase_no, id FROM v_messages WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' {' '.join(p)} ')" for k, p in enumerate(PHRASES)),
)
add(
    "fts_rank", lambda v: _said(v).bm25(search.parse_query(WORDS)).select("id", F.round("score", 6).alias("score")),
    f"SELECT id, round(score, 6) AS score FROM ({bm25_sql('v_messages', WORDS.split())}) x",
)
add(
    "jon_search_msg",
    lambda v: _said(v).bm25(search.parse_query(WORDS)).join(v("v_messages"), "id").join(v("v_conversations").select(F.col("id").alias("conversation_id"), "title", "source_app"), "conversation_id").select("id", "title", "source_app", "speaker", F.round("score", 6).alias("score")),
    f"SELECT m.id, title, source_app, speaker, round(score, 6) AS score FROM ({bm25_sql('v_messages', WORDS.split())}) x JOIN v_messages m USING (id) JOIN v_conversations c ON c.id = m.conversation_id",
)
FILES = "(SELECT a.id, coalesce(nullif(extracted_text, ''), caption, '') AS content FROM v_attachments a LEFT JOIN v_captions ON attachment_id = a.id)"


def _files(v: Views) -> DataFrame:
    return search.attachment_text(v("v_attachments"), v("v_captions"))


add(
    "jon_search_att",
    lambda v: _held(v).bm25(search.parse_query(WORDS)).join(_files(v), "id").join(v("v_conversations").select(F.col("id").alias("conversation_id"), "title"), "conversation_id").select("id", "title", F.concat(F.lit("file: "), "filename").alias("speaker"), F.round("score", 6).alias("score")),
    f"SELECT a.id, title, 'file: ' || filename AS speaker, round(score, 6) AS score FROM ({bm25_sql(FILES + ' f', WORDS.split())}) x JOIN v_attachments a USING (id) JOIN v_conversations c ON c.id = a.conversation_id",
)
add(
    "top_search", lambda v: search.search(v("v_messages"), v("v_conversations"), v("v_attachments"), v("v_captions"), "the model", 20, _said(v), _held(v)).select("pos", "kind", "id", F.round("score", 6).alias("score")),
    f"""WITH m AS ({bm25_sql('v_messages', ['the', 'model'])}), a AS ({bm25_sql(FILES + ' f', ['the', 'model'])})
    SELECT row_number() OVER (ORDER BY kind DESC, score DESC, id) AS pos, kind, id, round(score, 6) AS score FROM (SELECT * FROM (SELECT 'message' AS kind, id, score FROM m ORDER BY score DESC, id LIMIT 20) x
      UNION ALL SELECT * FROM (SELECT 'attachment', id, score FROM a ORDER BY score DESC, id LIMIT 20) y) z ORDER BY pos LIMIT 20""",
)
add(
    "set_union_fill", lambda v: search.search(v("v_messages"), v("v_conversations"), v("v_attachments"), v("v_captions"), "picture model", 20, _said(v), _held(v)).select("pos", "kind", "id"),
    f"""WITH m AS ({bm25_sql('v_messages', ['picture', 'model'])}), a AS ({bm25_sql(FILES + ' f', ['picture', 'model'])})
    SELECT row_number() OVER (ORDER BY kind DESC, score DESC, id) AS pos, kind, id FROM (SELECT * FROM (SELECT 'message' AS kind, id, score FROM m ORDER BY score DESC, id LIMIT 20) x
      UNION ALL SELECT * FROM (SELECT 'attachment', id, score FROM a ORDER BY score DESC, id LIMIT 20) y) z ORDER BY pos LIMIT 20""",
)
FALLBACK = """SELECT m.id, title, source_app, speaker, m.created_at, substring(content, 1, 200) AS snippet FROM (SELECT * FROM v_messages WHERE content ILIKE '%the%' ORDER BY id DESC LIMIT 20) m JOIN v_conversations c ON c.id = m.conversation_id"""
add("jon_search_like", lambda v: search.fallback(v("v_messages"), v("v_conversations"), "the and", 20), FALLBACK)
add("fts_fallback", lambda v: search.search(v("v_messages"), v("v_conversations"), v("v_attachments"), v("v_captions"), 'the "unclosed', 20), FALLBACK)
HIT = r"list_has_any(list_filter(string_split_regex(strip_accents(lower(w)), '[^\p{L}\p{N}]+'), lambda t: t <> ''), ['the', 'tion'])"
add(
    "fts_snippet", lambda v: v("v_messages").select("id", search.snippet(F.col("content"), ["the", "tion"]).alias("snippet")),
    rf"""WITH p AS (SELECT id, list_filter(string_split_regex(content, '\s+'), lambda w: w <> '') AS ps FROM v_messages), q AS (SELECT id, ps, list_transform(ps, lambda w: CAST({HIT} AS INT)) AS hs FROM p),
    c AS (SELECT id, ps, list_transform(range(1, len(hs) + 1), lambda i: list_sum(hs[i : i + 23])) AS cs FROM q), h AS (SELECT id, ps, coalesce(list_position(cs, list_max(cs)), 1) AS k FROM c)
    SELECT id, CASE WHEN k > 1 THEN ' … ' ELSE '' END || array_to_string(list_transform(list_slice(ps, k, k + 23), lambda w: CASE WHEN {HIT} THEN '>>' || w || '<<' ELSE w END), ' ') || CASE WHEN len(ps) >= k + 24 THEN ' … ' ELSE '' END AS snippet FROM h""",
)

add(
    "gra_decay", lambda v: viz.decay_points(v("v_facts"), NOW).where("not q").select("id", "age", "score"),
    f"SELECT id, round(greatest(0e0, {NOW}e0 - event_date) / 86400, 1) AS age, round({WEIGHT}, 4) AS score FROM v_facts WHERE {VALID}",
)
add("gra_edges", lambda v: viz.recall_edges(v("v_access_log"), v("v_facts")), f"{PAIRS} ORDER BY weight DESC, a, b LIMIT 120")
add(
    "gra_sediment", lambda v: viz.strata(v("v_facts")).groupBy("head").agg(F.count("*").alias("layers"), F.max("depth").alias("depth")),
    """WITH RECURSIVE s(head, id, depth) AS (SELECT h.id, e.id, 1 FROM v_facts h JOIN v_facts e ON e.superseded_by = h.id WHERE h.invalidated_at IS NULL AND h.quarantined_at IS NULL
      UNION ALL SELECT s.head, e.id, depth + 1 FROM s JOIN v_facts e ON e.superseded_by = s.id WHERE depth < 20)
    SELECT head, count(*) AS layers, max(depth) AS depth FROM (SELECT head, id, min(depth) AS depth FROM s WHERE id <> head GROUP BY head, id) x GROUP BY head""",
)
add(
    "gra_trace", lambda v: recall.trace(v("v_facts"), QUERY, query_vector(v), NOW, 10),
    f"WITH RECURSIVE {RANKED}, {fold('c', limit=10)} SELECT s.id, {IMP} AS imp, round(sem, 4) AS sem, least(kw, 3) AS kw, round(rec, 3) AS rec, round(s.score, 4) AS score, coalesce(state, 'dim') AS state FROM scored s LEFT JOIN fold USING (id) WHERE {VALID}",
)
add("vec_pca3", lambda v: viz.pca3(viz.embedded(v("v_facts"))))
add("vec_kmeans", lambda v: viz.clusters(viz.pca3(viz.embedded(v("v_facts")))).select("id", "cluster"))
add("vec_project", lambda v: viz.landscape(v("v_facts"), v("v_access_log"), NOW)["nodes"])
add("gra_landscape", lambda v: viz.landscape(v("v_facts"), v("v_access_log"), NOW)["clouds"])


def _colours(v: Views) -> DataFrame:
    near = viz.neighbours(viz.landscape(v("v_facts"), v("v_access_log"), NOW)["clouds"])
    pairs = [(r["a"], r["b"]) for r in near.collect()]  # at most 14 clusters
    found = viz.colours(pairs, max((max(p) for p in pairs), default=-1) + 1)
    return near.sparkSession.createDataFrame(sorted(found.items()), "cluster int, colour int")


add("gra_colour", _colours)
add("win_colour", _colours)


def _streamed(parts: list[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives that takes the parts one after another, each in a batch of its own or several."""
    spark, source, out, checkpoint = parts[0].sparkSession, *(new_path(parts[0].sparkSession, n) for n in ("source", "out", "checkpoint"))
    for part in parts:
        part.write.mode("append").parquet(source)
        rows = transform(spark.readStream.schema(part.schema).parquet(source))
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def _files_by_message(v: Views) -> DataFrame:
    return episodes.attachments_by_message(v("v_attachments"), v("v_captions"))


def _mined(v: Views) -> DataFrame:
    """Conversations after a mining run under a lease: each watermark at its last message."""
    homes = v("v_conversations")
    marks = leases.Marks(homes.sparkSession, new_path(homes.sparkSession, "marks"))
    ingest.mine_leased(marks, v("v_messages"), homes, _files_by_message(v), OWNER, NOW)
    return marks.conversations(homes)


def _left_by_another(v: Views) -> DataFrame:
    """What a second run gets while a first one holds every third conversation, a run that died held others, and one gave its own back."""
    homes = v("v_conversations").select("id")
    marks = leases.Marks(homes.sparkSession, new_path(homes.sparkSession, "marks"))
    marks.acquire(homes.where("id % 3 = 1"), NOW - 100.0, term=10.0)
    marks.acquire(homes.where("id % 3 = 0"), float(NOW))
    marks.release(marks.acquire(homes.where("id % 3 = 2"), float(NOW)))
    return marks.acquire(homes, NOW + 1.0).held


def _ingested_again(v: Views) -> DataFrame:
    """Counts of a batch that another query writes to a table that has it."""
    messages = v("v_messages")
    spark = messages.sparkSession
    table = sink.Table(spark, new_path(spark, "messages"), DDL["messages"], ["conversation_id", "external_id"], "id")
    table.commit(messages, "first", 0)
    table.commit(messages, "first", 0)
    again = table.commit(messages, "second", 0)
    return spark.createDataFrame([(again["ingested"], again["skipped"])], "ingested long, skipped long")


def _windows_by_turn(v: Views) -> DataFrame:
    """Windows of unmined messages that come in three parts, each with the next turns of all conversations."""
    bodies = episodes.with_bodies(episodes.unmined(v("v_messages"), v("v_conversations")), _files_by_message(v))
    sizes = stored(bodies.select("conversation_id", "id", F.col("view_len").cast("int").alias("view_len")), "sizes")
    turn = F.col("id") % 1000
    return _streamed([sizes.where(turn <= 2), sizes.where(turn.between(3, 4)), sizes.where(turn > 4)], lambda rows: windows.windows(rows, 2, 5000))


def _attached_late(v: Views) -> DataFrame:
    """Attachments that stream in beside their messages, bound to them, without those that the table has."""
    spark = v("v_messages").sparkSession
    files = v("v_attachments").select("id", "conversation_id", "message_external_id", "sha256", "created_at")
    messages = v("v_messages").select("conversation_id", "external_id", "id", "created_at")
    source = new_path(spark, "messages")
    messages.write.parquet(source)
    schema = "id long, conversation_id long, message_external_id string, sha256 string, created_at double, message_id long"
    table = sink.Table(spark, new_path(spark, "attachments"), schema, ["conversation_id", "message_external_id", "sha256"], "id")
    table.commit(files.where("id % 20 = 1").withColumn("message_id", F.lit(None).cast("long")), "before", 0)
    came = _streamed([files], lambda rows: windows.bound(rows, spark.readStream.schema(messages.schema).parquet(source)))
    waiting = files.join(came.select("id"), "id", "left_anti").withColumn("message_id", F.lit(None).cast("long"))  # what no watermark has passed yet
    table.commit(windows.settle(came.select(*waiting.columns).unionByName(waiting), messages).select(*table.read().columns), "stream", 0)
    return table.read().where("message_id is not null").select("id", "message_id")


add(
    "str_watermark", lambda v: _mined(v).select("id", "mined_upto"),
    "SELECT c.id, greatest(mined_upto, coalesce(last, 0)) AS mined_upto FROM v_conversations c LEFT JOIN (SELECT conversation_id, max(id) AS last FROM v_messages GROUP BY conversation_id) m ON m.conversation_id = c.id",
)
add("str_lock", _left_by_another, "SELECT id FROM v_conversations WHERE id % 3 <> 0")
add(
    "str_window", lambda v: _windows_by_turn(v).groupBy("conversation_id").agg(F.max("window_no").alias("windows")),
    f"WITH RECURSIVE {windowed(2, 5000)} SELECT conversation_id, max(window_no) AS windows FROM placed GROUP BY conversation_id",
)
add(
    "str_gate", lambda v: mining.window_facts(placed_windows(v, 1, 5000), OWNER).where("not mined").select("conversation_id", "window_no", "last_id"),
    f"WITH RECURSIVE {windowed(1, 5000)} SELECT conversation_id, window_no, id AS last_id FROM placed WHERE {SPEAKER} NOT IN ('owner', 'guest', 'guest-unknown')",
)
add("str_idempotent", _ingested_again, "SELECT 0 AS ingested, count(*) AS skipped FROM v_messages")
add(
    "str_late", _attached_late,
    """SELECT a.id, m.id AS message_id FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, message_external_id, sha256 ORDER BY id) AS nth FROM v_attachments) a JOIN v_messages m ON m.conversation_id = a.conversation_id AND m.external_id = a.message_external_id
    WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM v_attachments b WHERE b.id % 20 = 1 AND b.conversation_id = a.conversation_id AND b.message_external_id = a.message_external_id AND b.sha256 = a.sha256)""",
)
add(
    "str_crash", lambda v: facts.dedupe_in_conversation(v("v_facts").select("id", "conversation_id", "content_hash"), v("v_facts"), "id").agg(F.count_if(F.col("existing_id").isNotNull() | F.col("repeat")).alias("deduped"), F.count_if(F.col("existing_id").isNull() & ~F.col("repeat")).alias("added")),
    """WITH k AS (SELECT f.*, row_number() OVER (PARTITION BY conversation_id, content_hash ORDER BY id) AS nth, EXISTS (SELECT 1 FROM v_facts g WHERE g.conversation_id = f.conversation_id AND g.content_hash = f.content_hash AND g.invalidated_at IS NULL) AS known FROM v_facts f)
    SELECT count(*) FILTER (known OR nth > 1) AS deduped, count(*) FILTER (NOT known AND nth = 1) AS added FROM k""",
)
add(
    "str_late_fact", lambda v: mining.supersede_actions(v("v_facts").select("id", "event_date", F.lit(False).alias("quarantined"), F.array(F.col("id") + 1).alias("supersedes")), v("v_facts")).select("id", "old_id", "action"),
    "SELECT n.id, o.id AS old_id, CASE WHEN o.event_date - n.event_date > 86400 THEN 'refuse' ELSE 'apply' END AS action FROM v_facts n JOIN v_facts o ON o.id = n.id + 1",
)
add("str_feed", lambda v: episodes.tail(v("v_access_log").where("kind = 'recall'"), 30).select("id", "ts", "origin"), "SELECT id, ts, origin FROM v_access_log WHERE kind = 'recall' ORDER BY ts DESC, id DESC LIMIT 30")


def _replies(v: Views) -> DataFrame:
    """What a stand-in for the language model says of each mined window."""
    return mining.extract(mining.window_facts(placed_windows(v, 3, 2000), OWNER), lambda transcript: f"NEW: {len(transcript)} characters were said\nNONE")


add(
    "udf_complete", lambda v: _replies(v).select("conversation_id", "window_no", "line_no", "line"),
    f"""WITH RECURSIVE {windowed(3, 2000)}, w AS (SELECT conversation_id, window_no, length(string_agg('[msg ' || msg_no || '] ' || {LABEL} || ': ' || body, chr(10) || chr(10))) AS n
      FROM placed GROUP BY conversation_id, window_no HAVING bool_or({SPEAKER} IN ('owner', 'guest', 'guest-unknown')))
    SELECT conversation_id, window_no, 0 AS line_no, 'NEW: ' || n || ' characters were said' AS line FROM w UNION ALL SELECT conversation_id, window_no, 1, 'NONE' FROM w""",
)
add(
    "udf_retry", lambda v: mining.retry_scores(mining.parse_lines(v("v_lines")), lambda fact: len(fact) % 20).select("id", "importance"),
    "SELECT id, CAST(least(9, greatest(1, CASE WHEN id % 5 = 0 THEN length(trim(fact)) % 20 ELSE id % 12 END)) AS INT) AS importance FROM v_lines WHERE id % 23 <> 0 AND id % 19 <> 0 AND id % 29 <> 0",
)


def _pins(v: Views) -> DataFrame:
    """What a stand-in for the model names: of the offered ids every third, and one that nobody offered."""
    return summary.pin_nominations(v("v_facts"), lambda prompt: "#900000, " + ", ".join(i for i in re.findall(r"- \[(\d+)\]", prompt) if int(i) % 3 == 0))


add("udf_pin", _pins, f"SELECT id FROM v_facts WHERE {VALID} AND importance BETWEEN 7 AND 9 AND id % 3 = 0")


def _summary(v: Views) -> DataFrame:
    """A version of the summary by a stand-in model that writes too much at first; the window is small, so that pools are reduced in tasks."""
    content, sources = summary.drafted(v("v_facts"), NOW, 10, lambda prompt: "few words" if prompt.startswith("Shorten") else "many words " * 40, window=20_000)
    return sources.select(F.lit(content).alias("content"), F.lit(len(content.split())).alias("word_count"), "id")


add("udf_summary", _summary, f"WITH RECURSIVE {POOL} SELECT 'few words' AS content, 2 AS word_count, id FROM (SELECT id FROM d UNION ALL SELECT id FROM act) x")
VERSION = {"generated_at": float(NOW), "content": "new text", "source_fact_ids": [1], "word_count": 2, "word_budget": 800}
OLD_VERSIONS = "SELECT attachment_id AS id, caption AS content, CAST(NULL AS BIGINT) AS restored_from FROM v_captions"
add("snk_version", lambda v: summary.append_version(versions(v), VERSION).select("id", "content", "restored_from"), f"{OLD_VERSIONS} UNION ALL SELECT max(attachment_id) + 1, 'new text', NULL FROM v_captions")
add("snk_restore", lambda v: summary.restore(versions(v), 1, NOW).select("id", "content", "restored_from"), f"{OLD_VERSIONS} UNION ALL SELECT (SELECT max(attachment_id) + 1 FROM v_captions), caption, 1 FROM v_captions WHERE attachment_id = 1")
add(
    "txt_ids", lambda v: v("v_lines").select("id", F.array_join(F.array_distinct(F.regexp_extract_all("fact", F.lit(r"\d+"), F.lit(0))), ",").alias("ids")),
    r"SELECT id, coalesce((SELECT string_agg(x, ',' ORDER BY first) FROM (SELECT x, min(k) AS first FROM (SELECT unnest(regexp_extract_all(fact, '\d+')) AS x, generate_subscripts(regexp_extract_all(fact, '\d+'), 1) AS k) u GROUP BY x) y), '') AS ids FROM v_lines",
)
