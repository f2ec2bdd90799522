"""Queries over joins, aggregates, ordered folds, top-k lists and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..fixtures import NOW, QUERY
from ..functions import scoring, text
from ..operators import episodes, facts, mining, recall, search, settle, viz
from .registry import Views, add, query_vector
from .scans import id_rows, placed_windows, versions
from .sqltext import COLLAPSED, FACT, FACT_COLUMNS, FILE_BODIES, IMP, LABEL, SCORED, SPEAKER, VALID, WEIGHT, fold, windowed

# joins
add(
    "jon_caption", lambda v: search.attachment_text(v("v_attachments"), v("v_captions")).select("id", F.sha2("body", 256).alias("body_sha"), F.length("body").alias("chars")),
    f"SELECT id, sha256(body) AS body_sha, length(body) AS chars FROM {FILE_BODIES} x",
)
add(
    "jon_att_list", lambda v: episodes.list_attachments(v("v_attachments"), v("v_conversations")).select("id", "title", "source_app", "filename", "size"),
    "SELECT a.id, title, source_app, filename, size FROM (SELECT * FROM v_attachments ORDER BY id DESC LIMIT 200) a JOIN v_conversations c ON c.id = a.conversation_id",
)
add(
    "jon_att_preview",
    lambda v: episodes.preview(v("v_attachments"), v("v_conversations"), v("v_messages"), v("v_facts")).select("id", "title", "message_id", F.col("fact_ids").cast("string").alias("fact_ids"), "kind", "preview", "truncated"),
    f"""WITH n AS (SELECT conversation_id, '[' || string_agg(CAST(id AS VARCHAR), ', ' ORDER BY id DESC) || ']' AS fact_ids FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) AS nth FROM v_facts WHERE {VALID}) x WHERE nth <= 8 GROUP BY conversation_id)
    SELECT a.id, title, m.id AS message_id, fact_ids, CASE WHEN mime LIKE 'image/%' THEN 'image' WHEN extracted_text <> '' THEN 'text' ELSE 'binary' END AS kind, substring(extracted_text, 1, 4000) AS preview, length(extracted_text) > 4000 AS truncated
    FROM v_attachments a JOIN v_conversations c ON c.id = a.conversation_id LEFT JOIN v_messages m ON m.conversation_id = a.conversation_id AND m.external_id = a.message_external_id LEFT JOIN n ON n.conversation_id = a.conversation_id""",
)
add("jon_pending", lambda v: episodes.captionable(episodes.uncaptioned(v("v_attachments"), v("v_captions"))).select("id", "mime"), "SELECT id, mime FROM v_attachments WHERE mime IN ('image/jpeg', 'image/png', 'image/gif', 'image/webp') AND size <= 4500000 AND extracted_text = '' AND id NOT IN (SELECT attachment_id FROM v_captions)")
add(
    "jon_dedupe", lambda v: episodes.new_rows(v("v_messages"), v("v_messages").where("id % 3 = 0"), ["conversation_id", "external_id"], "id").select("id", "external_id"),
    "SELECT id, external_id FROM v_messages WHERE id % 3 <> 0",
)
add("jon_id_semi", lambda v: v("v_facts").join(id_rows(v, [5, 3, 900_000, 8, 3]), "id", "left_semi").select(*FACT_COLUMNS), f"SELECT {FACT} FROM v_facts WHERE id IN (5, 3, 900000, 8)")
add(
    "jon_shared", lambda v: v("v_attachments").select("id", "stored_name").join(v("v_attachments").groupBy("stored_name").agg(F.count("*").alias("n")).where("n > 1").select("stored_name"), "stored_name", "left_semi"),
    "SELECT id, stored_name FROM v_attachments a WHERE EXISTS (SELECT 1 FROM v_attachments b WHERE b.stored_name = a.stored_name AND b.id <> a.id)",
)
add(
    "jon_query_facts", lambda v: recall.scored(v("v_facts"), QUERY, query_vector(v), NOW).select("id", F.round("sem", 4).alias("sem"), "kw", F.round("rec", 4).alias("rec"), F.round("score", 4).alias("score"), "cand"),
    f"WITH {SCORED} SELECT id, round(sem, 4) AS sem, kw, round(rec, 4) AS rec, round(score, 4) AS score, cand FROM scored",
)
add(
    "jon_dup_edges", lambda v: recall.duplicate_edges(v("v_facts"), QUERY, query_vector(v), NOW, 20),
    f"""WITH {SCORED}, c AS (SELECT id, embedding, sem + 0.12e0 * least(kw, 3) + 0.05e0 AS static FROM scored WHERE cand AND {VALID} ORDER BY static DESC, id LIMIT 200),
    r AS (SELECT *, row_number() OVER (ORDER BY static DESC, id) AS pos FROM c), floor AS (SELECT coalesce((SELECT static - 0.10e0 FROM r WHERE pos = 20 AND (SELECT count(*) FROM r) > 20), -1e9) AS x),
    k AS (SELECT * FROM r WHERE static >= (SELECT x FROM floor) AND embedding IS NOT NULL)
    SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.pos < b.pos AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.93e0""",
)
PAIRS = f"""WITH x AS (SELECT id AS read, unnest(list_distinct(result_ids)) AS fact FROM v_access_log WHERE result_ids IS NOT NULL), y AS (SELECT x.* FROM x JOIN v_facts f ON f.id = x.fact WHERE {VALID})
    SELECT a.fact AS a, b.fact AS b, count(*) AS weight FROM y a JOIN y b ON a.read = b.read AND a.fact < b.fact GROUP BY ALL"""
add("jon_cooccur", lambda v: viz.recall_pairs(v("v_access_log"), v("v_facts")), PAIRS)
add(
    "jon_sediment", lambda v: viz.strata(v("v_facts")),
    f"""WITH RECURSIVE s(head, id, depth) AS (SELECT h.id, e.id, 1 FROM v_facts h JOIN v_facts e ON e.superseded_by = h.id WHERE h.invalidated_at IS NULL AND h.quarantined_at IS NULL
      UNION ALL SELECT s.head, e.id, depth + 1 FROM s JOIN v_facts e ON e.superseded_by = s.id WHERE depth < 20)
    SELECT head, id, min(depth) AS depth FROM s WHERE id <> head GROUP BY head, id""",
)


def _lines(v: Views) -> DataFrame:
    """Mining lines dealt to the windows: a line's window is one of those of a conversation."""
    w = placed_windows(v, 3, 2000).select("conversation_id", "window_no").distinct()
    lines = v("v_lines").select(F.col("id").alias("line_no"), "line", (F.col("id") % 600 + 1).alias("conversation_id"))
    return mining.parse_lines(lines.join(w, "conversation_id"))


SRC = "CASE WHEN id % 6 = 0 THEN NULL ELSE id % 9 END"
GOOD_LINE = "id % 23 <> 0 AND id % 19 <> 0 AND id % 29 <> 0"
add(
    "jon_src_bind", lambda v: mining.bind(_lines(v), placed_windows(v, 3, 2000)).select("line_no", "conversation_id", "window_no", "src", "bound", "bound_id", "bound_at"),
    f"""WITH RECURSIVE {windowed(3, 2000)}, last AS (SELECT conversation_id, window_no, max(id) AS l_id, arg_max(created_at, id) AS l_at FROM placed GROUP BY ALL),
    x AS (SELECT l.id AS line_no, id % 600 + 1 AS conversation_id, {SRC} AS src FROM v_lines l WHERE {GOOD_LINE})
    SELECT line_no, x.conversation_id, last.window_no, src, p.id IS NOT NULL AS bound, coalesce(p.id, l_id) AS bound_id, coalesce(p.created_at, l_at) AS bound_at
    FROM x JOIN last USING (conversation_id) LEFT JOIN placed p ON p.conversation_id = x.conversation_id AND p.window_no = last.window_no AND p.msg_no = src""",
)


def _actions(v: Views) -> DataFrame:
    new = v("v_facts").select("id", "event_date", F.col("quarantined_at").isNotNull().alias("quarantined"), F.array(F.col("id") - 1, F.col("id") - 3, F.lit(900_000).cast("long")).alias("supersedes"))
    return mining.supersede_actions(new, v("v_facts").where(schema.valid()))


ACTIONS = f"""SELECT n.id, n.pos, n.old_id, CASE WHEN n.q THEN 'defer' WHEN o.event_date - n.event_date > 86400 THEN 'refuse' ELSE 'apply' END AS action
    FROM (SELECT id, event_date, quarantined_at IS NOT NULL AS q, unnest([0, 1]) AS pos, unnest([id - 1, id - 3]) AS old_id FROM v_facts) n JOIN (SELECT id, event_date FROM v_facts WHERE {VALID}) o ON o.id = n.old_id"""
add("jon_supersede", _actions, ACTIONS)
RECALLED = [2, 9, 900_000, 16]
MERGED = f"SELECT DISTINCT f.id, content_hash FROM v_facts f WHERE id IN (2, 9, 16) OR id IN (SELECT id FROM v_facts WHERE {VALID} ORDER BY id DESC LIMIT 250)"
add("jon_cand_merge", lambda v: facts.supersede_candidates(v("v_facts"), id_rows(v, RECALLED)).select("id", "content_hash"), MERGED)
add("set_union_key", lambda v: facts.supersede_candidates(v("v_facts"), id_rows(v, RECALLED), 100).select("id", "content_hash"), MERGED.replace("250", "100"))
add(
    "jon_line_score", lambda v: v("v_facts").select("id").join(facts.parse_scores(v("v_facts").where("id % 2 = 0").select(F.col("id").alias("pos"), F.concat(F.col("id").cast("string"), F.lit("=7")).alias("text"))), "id", "left").select("id", "score"),
    "SELECT id, CASE WHEN id % 2 = 0 THEN 7 END AS score FROM v_facts",
)

# aggregates
add("agg_health", lambda v: facts.health(v("v_facts")).drop("pending_review"), f"SELECT count(*) AS total, count(*) FILTER ({VALID}) AS current, count(*) FILTER (invalidated_at IS NOT NULL) AS superseded, count(*) FILTER (quarantined_at IS NOT NULL) AS quarantined FROM v_facts")
add(
    "agg_att", lambda v: v("v_attachments").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("extracted_text") != "").alias("searchable")),
    "SELECT count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(*) FILTER (extracted_text <> '') AS searchable FROM v_attachments",
)
add(
    "agg_dup_groups", lambda v: facts.duplicate_groups(v("v_facts")),
    f"SELECT * FROM (SELECT id, content_hash, count(*) OVER (PARTITION BY content_hash) AS n FROM v_facts WHERE {VALID}) x WHERE n > 1",
)
add(
    "agg_keep", lambda v: facts.keepers(v("v_facts")),
    f"""SELECT content_hash, n, id AS keep_id FROM (SELECT *, count(*) OVER (PARTITION BY content_hash) AS n, row_number() OVER (PARTITION BY content_hash ORDER BY coalesce(importance, 5) DESC, created_at DESC, id DESC) AS nth
      FROM v_facts WHERE {VALID}) x WHERE n > 1 AND nth = 1""",
)
add("agg_stamp", lambda v: viz.projection_stamp(v("v_facts")), "SELECT 'v2:' || count(*) || ':' || coalesce(max(id), 0) AS stamp FROM v_facts WHERE embedding IS NOT NULL")
add("agg_edges", lambda v: viz.recall_edges(v("v_access_log"), v("v_facts")), f"{PAIRS} ORDER BY weight DESC, a, b LIMIT 120")


def _coords(v: Views) -> DataFrame:
    """Facts with a vector, placed by its first three entries, in six given clusters."""
    fresh = viz.decay_points(v("v_facts"), NOW).select("id", F.col("score").alias("fresh"))
    rows = v("v_facts").where("embedding is not null").select("id", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")), (F.col("id") % 6).alias("cluster"))
    return rows.join(fresh, "id")


COORDS = f"c AS (SELECT id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, id % 6 AS cluster, round({WEIGHT}, 4) AS fresh FROM v_facts WHERE embedding IS NOT NULL AND invalidated_at IS NULL)"
add(
    "agg_cluster", lambda v: viz.cluster_stats(_coords(v)).select("cluster", "size", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "fresh"))),
    f"WITH {COORDS} SELECT cluster, count(*) AS size, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, round(avg(fresh), 6) AS fresh FROM c GROUP BY cluster",
)
COVARIANCES = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
add(
    "agg_cov", lambda v: viz.cluster_stats(_coords(v)).select("cluster", *(F.round(f"cov_{a}{b}", 6).alias(f"cov_{a}{b}") for a, b in COVARIANCES)),
    f"WITH {COORDS} SELECT cluster, {', '.join(f'round(covar_pop({a}, {b}), 6) AS cov_{a}{b}' for a, b in COVARIANCES)} FROM c GROUP BY cluster",
)
add(
    "agg_spread", lambda v: viz.cluster_stats(_coords(v)).select("cluster", F.round("spread", 6).alias("spread")),
    f"WITH {COORDS}, m AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM c GROUP BY cluster) SELECT cluster, round(avg(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)), 6) AS spread FROM c JOIN m USING (cluster) GROUP BY cluster",
)
add(
    "jon_coords", lambda v: _coords(v).join(viz.lifecycle(v("v_facts")), "id").select("id", "cluster", F.round("x", 6).alias("x"), "fresh", "c", "ed"),
    f"WITH {COORDS} SELECT c.id, cluster, round(x, 6) AS x, fresh, round(created_at, 1) AS c, round(event_date, 1) AS ed FROM c JOIN v_facts f USING (id)",
)
add(
    "jon_knn", lambda v: viz.neighbours(viz.cluster_stats(_coords(v)).select("cluster", "cx", "cy", "cz")),
    f"""WITH {COORDS}, m AS (SELECT cluster, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM c GROUP BY cluster),
    n AS (SELECT a.cluster AS a, b.cluster AS b, row_number() OVER (PARTITION BY a.cluster ORDER BY (a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2, b.cluster) AS nth FROM m a JOIN m b ON a.cluster <> b.cluster)
    SELECT a, b FROM n WHERE nth <= 3 UNION SELECT b, a FROM n WHERE nth <= 3""",
)
add(
    "agg_gram_means", lambda v: viz.gram_means(viz.embedded(v("v_facts"))).select("id", F.round("row_mean", 6).alias("row_mean"), F.round("grand_mean", 6).alias("grand_mean")),
    """WITH p AS (SELECT id, embedding::DOUBLE[] AS e FROM v_facts WHERE embedding IS NOT NULL ORDER BY id DESC LIMIT 2500), g AS (SELECT a.id AS id, avg(list_dot_product(a.e, b.e)) AS m FROM p a, p b GROUP BY a.id)
    SELECT id, round(m, 6) AS row_mean, round(avg(m) OVER (), 6) AS grand_mean FROM g""",
)
add(
    "agg_drops", lambda v: mining.drop_counts(mining.parse_lines(v("v_lines"))),
    f"SELECT CASE WHEN id % 13 = 0 THEN 'builder-process' ELSE 'system-meta' END AS reason, count(*) AS n FROM v_lines WHERE {GOOD_LINE} AND (id % 13 = 0 OR id % 17 = 0) GROUP BY reason",
)
add("agg_words", lambda v: v("v_facts").select("id", text.word_count(F.col("content")).alias("words")), r"SELECT id, len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')) AS words FROM v_facts")
add(
    "agg_group_map", lambda v: episodes.files_by_message(v("v_attachments")).select("conversation_id", "external_id", F.array_join(F.transform("files", lambda f: F.concat(f["id"].cast("string"), F.lit(" "), f["filename"], F.lit(" "), f["size"].cast("string"))), ", ").alias("files")),
    "SELECT conversation_id, message_external_id AS external_id, string_agg(id || ' ' || filename || ' ' || size, ', ' ORDER BY id) AS files FROM v_attachments GROUP BY conversation_id, message_external_id",
)
add(
    "agg_speaker_any", lambda v: mining.window_facts(placed_windows(v, 3, 2000), "Alex").select("conversation_id", "window_no", "mined", "untrusted"),
    f"""WITH RECURSIVE {windowed(3, 2000)} SELECT conversation_id, window_no, bool_or({SPEAKER} IN ('owner', 'guest', 'guest-unknown')) AS mined,
      bool_or({SPEAKER} IN ('guest', 'guest-unknown', 'unrecognised')) AS untrusted FROM placed GROUP BY conversation_id, window_no""",
)
PRUNED = f"""{SCORED}, c AS (SELECT id, embedding, sem + 0.12e0 * least(kw, 3) + 0.05e0 AS static FROM scored WHERE cand AND {VALID} ORDER BY static DESC, id LIMIT 200),
    r AS (SELECT *, row_number() OVER (ORDER BY static DESC, id) AS pos FROM c), floor AS (SELECT coalesce((SELECT static - 0.10e0 FROM r WHERE pos = 20 AND (SELECT count(*) FROM r) > 20), -1e9) AS x)"""
add(
    "win_prune", lambda v: recall.pruned(v("v_facts"), QUERY, query_vector(v), NOW, 20).select("pos", "id"),
    f"WITH {PRUNED} SELECT pos - 1 AS pos, id FROM r WHERE static >= (SELECT x FROM floor) AND embedding IS NOT NULL",
)
add(
    "prj_out", lambda v: recall.recall(v("v_facts"), QUERY, query_vector(v), NOW, 40, include_superseded=True).select(*recall.RECALL_FIELDS),
    f"""WITH RECURSIVE {SCORED}, c AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS rn, id, score, {COLLAPSED} FROM scored WHERE cand AND quarantined_at IS NULL), {fold("c", limit=40)}
    SELECT f.id, content, event_date, confidence, origin_agent, round(fold.score, 4) AS score FROM fold JOIN v_facts f USING (id) WHERE state = 'kept'""",
)
add(
    "flt_valid_recall", lambda v: recall.readable(v("v_facts"), False).select("id", F.lit(False).alias("old")).unionByName(recall.readable(v("v_facts"), True).select("id", F.lit(True).alias("old"))),
    f"SELECT id, false AS old FROM v_facts WHERE {VALID} UNION ALL SELECT id, true FROM v_facts WHERE quarantined_at IS NULL",
)

# ordered folds
add("win_msgno", lambda v: mining.numbered_messages(v("v_messages")).select("id", "msg_no"), "SELECT id, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS msg_no FROM v_messages")
add("win_chunk", lambda v: placed_windows(v, 3, 2000).select("id", "window_no", "msg_no"), f"WITH RECURSIVE {windowed(3, 2000)} SELECT id, window_no, msg_no FROM placed")
RANKED = f"{SCORED}, c AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS rn, id, score, {COLLAPSED} FROM scored WHERE cand AND {VALID})"
add(
    "win_collapse", lambda v: recall.recall(v("v_facts"), QUERY, query_vector(v), NOW, 50).select("id", "score"),
    f"WITH RECURSIVE {RANKED}, {fold('c', limit=50)} SELECT id, round(score, 4) AS score FROM fold WHERE state = 'kept'",
)
add(
    "win_trace_state", lambda v: recall.trace(v("v_facts"), QUERY, query_vector(v), NOW, 20).select("id", "state"),
    f"WITH RECURSIVE {RANKED}, {fold('c', limit=20)} SELECT s.id, coalesce(state, 'dim') AS state FROM scored s LEFT JOIN fold USING (id) WHERE {VALID}",
)
POOL = f"""r AS (SELECT *, {IMP} AS imp, {WEIGHT} AS weight FROM v_facts WHERE {VALID}),
o AS (SELECT * FROM r WHERE imp < 10 ORDER BY imp DESC, event_date DESC, id LIMIT 250),
c1 AS (SELECT row_number() OVER (ORDER BY k, CASE WHEN k = 0 THEN 0 ELSE -imp END, CASE WHEN k = 0 THEN 0 ELSE -event_date END, id) AS rn, id, weight AS score, {COLLAPSED} FROM (SELECT *, 0 AS k FROM r WHERE imp >= 10 UNION ALL SELECT *, 1 FROM o) x),
{fold("c1", "f1")}, d AS (SELECT id, rn FROM (SELECT id, rn, row_number() OVER (ORDER BY rn) AS nth FROM f1 WHERE state = 'kept') x WHERE nth <= 200 + (SELECT count(*) FROM r WHERE imp >= 10)),
a AS (SELECT * FROM r WHERE id NOT IN (SELECT id FROM d) ORDER BY weight DESC, id LIMIT 375),
c2 AS (SELECT row_number() OVER (ORDER BY k, j, id) AS rn, id, weight AS score, {COLLAPSED} FROM (SELECT r.*, 0 AS k, CAST(d.rn AS DOUBLE) AS j FROM r JOIN d USING (id) UNION ALL SELECT *, 1, -weight FROM a) x),
{fold("c2", "f2")}, act AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY rn) AS nth FROM f2 WHERE state = 'kept' AND id NOT IN (SELECT id FROM d)) x WHERE nth <= 300)"""
add("win_durable", lambda v: recall.pools(v("v_facts"), NOW).where("pool = 'durable'").select("id", "imp"), f"WITH RECURSIVE {POOL} SELECT id, imp FROM r WHERE id IN (SELECT id FROM d)")
add("win_active", lambda v: recall.pools(v("v_facts"), NOW).where("pool = 'active'").select("id", "imp"), f"WITH RECURSIVE {POOL} SELECT id, imp FROM r WHERE id IN (SELECT id FROM act)")
add(
    "win_pool_order", lambda v: recall.pools(v("v_facts"), NOW).selectExpr("pool", "id", "row_number() over (partition by pool order by coalesce(event_date, 0), id) as place"),
    f"""WITH RECURSIVE {POOL} SELECT pool, id, row_number() OVER (PARTITION BY pool ORDER BY event_date, id) AS place FROM (SELECT 'durable' AS pool, id, event_date FROM r WHERE id IN (SELECT id FROM d)
      UNION ALL SELECT 'active', id, event_date FROM r WHERE id IN (SELECT id FROM act)) x""",
)
add("set_union_all", lambda v: recall.pools(v("v_facts"), NOW).groupBy("pool").agg(F.count("*").alias("n")), f"WITH RECURSIVE {POOL} SELECT 'durable' AS pool, count(*) AS n FROM d HAVING count(*) > 0 UNION ALL SELECT 'active', count(*) FROM act HAVING count(*) > 0")


def _said(v: Views) -> DataFrame:
    """Two lines a fact: some say it again, some something new, many claim facts that later lines say."""
    k, two = F.col("id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("nth")
    again = F.when(k % 5 == 4, F.concat(F.lit("new-"), (k % 300).cast("string"))).otherwise(F.col("content_hash"))
    claims = F.when(k % 3 == 0, F.array(k + 5, k + 6, k + 900_000)).when(k % 7 == 0, F.array(k + 6, k - 3)).when(k % 4 == 0, F.array(k + 2))
    rows = v("v_facts").select("*", two)
    return rows.select(
        (k * 2 + F.col("nth")).alias("seq"), F.when(k % 8 == 1, F.col("conversation_id") + 1).when(k % 41 != 0, F.col("conversation_id")).alias("conversation_id"), again.alias("content_hash"),
        (F.col("quarantined_at").isNotNull() | (k % 17 == F.col("nth"))).alias("quarantined"), "event_date", claims.alias("supersedes"),
    )


SETTLED = f"""l AS (SELECT id * 2 + nth AS seq, CASE WHEN id % 8 = 1 THEN conversation_id + 1 WHEN id % 41 <> 0 THEN conversation_id END AS conv, CASE WHEN id % 5 = 4 THEN 'new-' || (id % 300) ELSE content_hash END AS h,
    quarantined_at IS NOT NULL OR id % 17 = nth AS held, event_date, CASE WHEN id % 3 = 0 THEN [id + 5, id + 6, id + 900000] WHEN id % 7 = 0 THEN [id + 6, id - 3] WHEN id % 4 = 0 THEN [id + 2] ELSE [] END AS ids FROM v_facts CROSS JOIN (VALUES (0), (1)) t(nth)),
  k AS (SELECT seq, f.id AS old_id, c.pos, f.event_date - c.event_date > 86400 AS refused FROM (SELECT seq, event_date, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM l) c JOIN v_facts f ON f.id = c.id WHERE {VALID}),
  c AS (SELECT l.*, row_number() OVER (ORDER BY l.seq) AS rn, coalesce(b.ids, []) AS blocked, coalesce(w.ids, []) AS wanted FROM l
    LEFT JOIN (SELECT conversation_id, content_hash, list(id) AS ids FROM v_facts WHERE invalidated_at IS NULL GROUP BY ALL) b ON b.conversation_id = l.conv AND b.content_hash = l.h
    LEFT JOIN (SELECT seq, list(old_id) AS ids FROM k WHERE NOT refused GROUP BY seq) w ON w.seq = l.seq),
  s(rn, said, gone, before, seq, outcome) AS (SELECT 0::BIGINT, []::VARCHAR[], []::BIGINT[], []::BIGINT[], NULL::BIGINT, ''
    UNION ALL SELECT rn, CASE WHEN outcome <> 'repeat' AND conv IS NOT NULL THEN list_append(said, conv || ':' || h) ELSE said END, CASE WHEN outcome = 'added' THEN list_concat(gone, wanted) ELSE gone END, gone, seq, outcome
    FROM (SELECT c.*, s.said, s.gone, CASE WHEN c.conv IS NOT NULL AND (list_contains(s.said, c.conv || ':' || c.h) OR NOT list_has_all(s.gone, c.blocked)) THEN 'repeat' WHEN c.held THEN 'held' ELSE 'added' END AS outcome FROM s JOIN c ON c.rn = s.rn + 1) x),
  done AS (SELECT seq, pos, old_id, CASE WHEN outcome = 'held' THEN 'defer' WHEN refused THEN 'refuse' WHEN list_contains(before, old_id) THEN 'late' ELSE 'apply' END AS action FROM k JOIN s USING (seq) WHERE outcome <> 'repeat')"""
add("win_line_seq", lambda v: settle.settle(_said(v), v("v_facts"))[0], f"WITH RECURSIVE {SETTLED} SELECT seq, outcome FROM s WHERE rn > 0")
add("jon_supersede_first", lambda v: settle.settle(_said(v), v("v_facts"))[1], f"WITH RECURSIVE {SETTLED} SELECT seq, pos, old_id, action FROM done")
add(
    "agg_distill", lambda v: settle.counts(*settle.settle(_said(v), v("v_facts"))),
    f"""WITH RECURSIVE {SETTLED} SELECT count(*) FILTER (outcome <> 'repeat') AS added, count(*) FILTER (outcome = 'held') AS quarantined, count(*) FILTER (outcome = 'repeat') AS deduped,
      (SELECT count(*) FROM done WHERE action = 'refuse') AS refused, (SELECT count(*) FROM done WHERE action = 'defer') AS deferred FROM s WHERE rn > 0""",
)
add(
    "txt_transcript", lambda v: mining.window_facts(placed_windows(v, 3, 2000), "Alex").select("conversation_id", "window_no", F.sha2("transcript", 256).alias("sha")),
    f"""WITH RECURSIVE {windowed(3, 2000)} SELECT conversation_id, window_no, sha256(string_agg('[msg ' || msg_no || '] ' || {LABEL} || ': ' || body, chr(10) || chr(10) ORDER BY msg_no)) AS sha
    FROM placed GROUP BY conversation_id, window_no""",
)

# top-k and sets
add("top_recent", lambda v: recall.recall(v("v_facts"), " ", None, NOW, 50).select(*FACT_COLUMNS), f"SELECT {FACT} FROM v_facts WHERE quarantined_at IS NULL ORDER BY id DESC LIMIT 50")
add(
    "top_recall", lambda v: recall.recall(v("v_facts"), QUERY, query_vector(v), NOW, 10, include_superseded=True).select("pos", "id", "score"),
    f"""WITH RECURSIVE {SCORED}, c AS (SELECT row_number() OVER (ORDER BY score DESC, id) AS rn, id, score, {COLLAPSED} FROM scored WHERE cand AND quarantined_at IS NULL), {fold("c", limit=10)}
    SELECT rn - 1 AS pos, id, round(score, 4) AS score FROM fold WHERE state = 'kept'""",
)
add(
    "prj_recall", lambda v: recall.recall(v("v_facts"), QUERY, query_vector(v), NOW, 20).select(*recall.RECALL_FIELDS),
    f"WITH RECURSIVE {RANKED}, {fold('c', limit=20)} SELECT f.id, content, event_date, confidence, origin_agent, round(fold.score, 4) AS score FROM fold JOIN v_facts f USING (id) WHERE state = 'kept'",
)
add("top_facts", lambda v: facts.list_facts(v("v_facts")).select(*FACT_COLUMNS), f"SELECT {FACT} FROM v_facts WHERE {VALID} ORDER BY id DESC LIMIT 100")
add("top_tail", lambda v: episodes.tail(v("v_access_log"), 50).select("id", "ts", "kind"), "SELECT id, ts, kind FROM v_access_log ORDER BY ts DESC, id DESC LIMIT 50")
add("top_att", lambda v: episodes.list_attachments(v("v_attachments"), v("v_conversations"), 50).select("id", "filename"), "SELECT id, filename FROM (SELECT * FROM v_attachments ORDER BY id DESC LIMIT 50) a")
add(
    "top_preview", lambda v: episodes.preview(v("v_attachments"), v("v_conversations"), v("v_messages"), v("v_facts")).select("id", F.size("fact_ids").alias("n"), F.get("fact_ids", 0).alias("newest")),
    f"""SELECT a.id, n, newest FROM v_attachments a LEFT JOIN (SELECT conversation_id, least(count(*), 8) AS n, max(id) AS newest FROM v_facts WHERE {VALID} GROUP BY conversation_id) f USING (conversation_id)""",
)
add("top_versions", lambda v: episodes.version_meta(versions(v)).select("id", "generated_at"), "SELECT attachment_id AS id, created_at AS generated_at FROM v_captions")
add("top_supersede", lambda v: facts.supersede_candidates(v("v_facts"), recall.recall(v("v_facts"), QUERY, query_vector(v), NOW, 40).select("id")).select("id"), f"""WITH RECURSIVE {RANKED}, {fold("c", limit=40)}
    SELECT id FROM fold WHERE state = 'kept' UNION SELECT * FROM (SELECT id FROM v_facts WHERE {VALID} ORDER BY id DESC LIMIT 250) x""")
add("top_sample", lambda v: viz.embedded(v("v_facts")).select("id", "content_hash"), "SELECT id, content_hash FROM v_facts WHERE embedding IS NOT NULL ORDER BY id DESC LIMIT 2500")
add("top_edges", lambda v: viz.recall_edges(v("v_access_log"), v("v_facts"), 20), f"{PAIRS} ORDER BY weight DESC, a, b LIMIT 20")
add(
    "top_backups", lambda v: episodes.retained(v("v_attachments").select(F.col("conversation_id").cast("string").alias("place"), F.col("filename").alias("name")), 2),
    "SELECT place, name FROM (SELECT CAST(conversation_id AS VARCHAR) AS place, filename AS name, row_number() OVER (PARTITION BY conversation_id ORDER BY filename DESC) AS nth FROM v_attachments) x WHERE nth <= 2",
)
add(
    "set_except", lambda v: v("v_facts").where(schema.valid()).join(recall.pools(v("v_facts"), NOW).select("id"), "id", "left_anti").select("id"),
    f"WITH RECURSIVE {POOL} SELECT id FROM r WHERE id NOT IN (SELECT id FROM d) AND id NOT IN (SELECT id FROM act)",
)
add(
    "set_intersect", lambda v: v("v_facts").where(schema.valid()).select("id").join(v("v_access_log").where("result_ids is not null").select(F.explode("result_ids").alias("id")).distinct(), "id", "left_semi"),
    f"SELECT id FROM v_facts WHERE {VALID} INTERSECT SELECT unnest(result_ids) FROM v_access_log",
)
add(
    "set_partition", lambda v: facts.quarantine_report(v("v_facts"), v("v_facts").selectExpr("id + id % 2 * 7 as id", "id as pos")).groupBy("outcome").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN f.id IS NOT NULL THEN 'quarantined' ELSE 'skipped' END AS outcome, count(*) AS n FROM (SELECT DISTINCT id + id % 2 * 7 AS id FROM v_facts) t LEFT JOIN v_facts f ON f.id = t.id AND f.quarantined_at IS NULL GROUP BY outcome",
)

# scores
S = "v_facts"
add("scl_recency", lambda v: v(S).select("id", F.round(scoring.recency(F.col("event_date"), F.col("created_at"), NOW), 6).alias("rec")), f"WITH {SCORED} SELECT id, round(rec, 6) AS rec FROM scored")
add("scl_recall_score", lambda v: recall.scored(v(S), QUERY, query_vector(v), NOW).select("id", F.round("score", 4).alias("score")), f"WITH {SCORED} SELECT id, round(score, 4) AS score FROM scored")
add("scl_kw", lambda v: v(S).select("id", scoring.keyword_hits(F.col("content"), scoring.query_words(QUERY)).alias("kw")), f"WITH {SCORED} SELECT id, kw FROM scored")
add("scl_halflife", lambda v: v(S).select("id", scoring.half_life_days(F.coalesce(scoring.truthy(F.col("importance")), F.lit(5))).alias("days")), f"SELECT id, CASE WHEN {IMP} >= 10 THEN 'inf'::DOUBLE ELSE 30 * (0.5e0 + {IMP} / 4e0) END AS days FROM v_facts")
add("scl_decay", lambda v: v(S).select("id", F.round(scoring.weight_score(F.col("importance"), F.col("event_date"), F.col("created_at"), NOW), 6).alias("score")), f"SELECT id, round({WEIGHT}, 6) AS score FROM v_facts")
add(
    "scl_decay_point", lambda v: viz.decay_points(v(S), NOW),
    f"SELECT id, {IMP} AS importance, round(greatest(0e0, {NOW}e0 - event_date) / 86400, 1) AS age, round({WEIGHT}, 4) AS score, quarantined_at IS NOT NULL AS q FROM v_facts WHERE invalidated_at IS NULL",
)
