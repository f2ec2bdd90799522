"""Memory tables derived from the driver's tables, in SQL text that Spark and DuckDB both run.

The given tables hold no facts, speakers or prose dates, so each memory table is a deterministic view
over them. duck() gives the same views as common table expressions for the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .operators.tables import stored

NOW = 1735689600
OWNER = "Alex"
TRUSTED_APPS = ["chat-app"]
ALLOWED = ["acme", "alex"]
QUERY = "the ththe tion with ation over"
QUERY_VECTOR = 3

# {name} marks what the engines spell differently, see DIALECTS; #name# marks a table or another view.
VIEWS = {
    "v_conversations": """
        SELECT conv_id + 1 AS id, CASE WHEN conv_id % 4 = 3 THEN 'other-app' ELSE 'chat-app' END AS source_app, concat('chat-', conv_id) AS external_id,
          CASE WHEN conv_id % 5 = 0 THEN '' ELSE concat('Conversation ', conv_id) END AS title, conv_id * 1000 + conv_id % 3 AS mined_upto,
          CAST(1700000000 + conv_id * 3600 AS DOUBLE) AS created_at
        FROM (SELECT DISTINCT conv_id FROM #conversations#) c""",
    "v_messages": """
        SELECT conv_id * 1000 + turn + 1 AS id, conv_id + 1 AS conversation_id, concat('m-', conv_id, '-', turn) AS external_id,
          CASE WHEN role = 'user' AND conv_id % 9 = 4 THEN 'guest:Sam' WHEN role = 'user' AND conv_id % 9 = 7 THEN 'guest:unknown'
            WHEN role = 'user' AND conv_id % 9 = 8 THEN 'agent:scribe' WHEN role = 'assistant' THEN 'model-a' ELSE role END AS speaker,
          text AS content, CAST(1700000000 + conv_id * 3600 + turn * 60 AS DOUBLE) AS created_at
        FROM #conversations#""",
    "v_facts": """
        SELECT d.doc_id + 1 AS id, d.text AS content, CASE WHEN d.doc_id % 3 = 0 THEN 'chat' ELSE 'user' END AS source,
          CASE d.doc_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'chat-app' ELSE 'mcp:tool' END AS origin_agent,
          d.doc_id % 100 + 1 AS conversation_id, CAST(NULL AS BIGINT) AS source_message_id,
          CAST(1735689600 - (d.doc_id * 37 % 1500) * 86400 + 3600 AS DOUBLE) AS created_at, CAST(1735689600 - (d.doc_id * 37 % 1500) * 86400 AS DOUBLE) AS event_date,
          CASE WHEN d.doc_id % 3 = 2 THEN 'low' ELSE 'high' END AS confidence,
          CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE CAST(1 + d.doc_id % 10 AS INT) END AS importance,
          {hash:d.text} AS content_hash, CASE WHEN d.doc_id % 5 = 0 THEN p.embedding ELSE o.embedding END AS embedding,
          CASE WHEN d.doc_id % 39 IN (5, 18) THEN CAST(1700000000 AS DOUBLE) END AS invalidated_at, CASE WHEN d.doc_id % 39 IN (5, 18) THEN d.doc_id + 14 END AS superseded_by,
          CASE WHEN d.doc_id % 11 = 3 THEN CAST(1700000000 AS DOUBLE) END AS quarantined_at, CASE WHEN d.doc_id % 11 = 3 THEN 'external write' END AS quarantine_reason,
          CASE WHEN d.doc_id % 22 = 3 THEN CAST(1700000100 AS DOUBLE) END AS review_dismissed_at
        FROM #documents# d LEFT JOIN #embeddings# o ON o.vec_id = d.doc_id LEFT JOIN #embeddings# p ON p.vec_id = d.doc_id - 1""",
    "v_attachments": """
        SELECT d.doc_id + 1 AS id, c.conv_id + 1 AS conversation_id, concat('m-', c.conv_id, '-0') AS message_external_id,
          CASE WHEN d.doc_id % 20 = 0 THEN concat('f', d.doc_id, '.png') ELSE concat('f', d.doc_id, '.txt') END AS filename,
          CASE WHEN d.doc_id % 20 = 0 THEN CASE WHEN d.doc_id % 60 = 0 THEN 'image/tiff' ELSE 'image/png' END ELSE 'text/plain' END AS mime,
          d.n_chars * CASE WHEN d.doc_id % 100 = 20 THEN 10000 ELSE 1 END AS size, {sha:d.text} AS sha256, concat({sha:d.text}, CASE WHEN d.doc_id % 20 = 0 THEN '.png' ELSE '.txt' END) AS stored_name,
          CASE WHEN d.doc_id % 20 = 0 THEN '' ELSE d.text END AS extracted_text, CAST(1700000000 + d.doc_id AS DOUBLE) AS created_at
        FROM (SELECT *, doc_id % (SELECT max(conv_id) + 1 FROM #conversations#) AS home FROM #documents#) d JOIN (SELECT DISTINCT conv_id FROM #conversations#) c ON c.conv_id = d.home""",
    "v_captions": """
        SELECT id AS attachment_id, concat('[Image description (auto-generated by model-a): picture ', id, ']') AS caption, 'model-a' AS model, CAST(1700000500 AS DOUBLE) AS created_at
        FROM #v_attachments# WHERE mime LIKE 'image/%' AND id % 40 = 1""",
    "v_access_log": """
        SELECT event_id + 1 AS id, {epoch:ts} AS ts, CASE WHEN event_type IN ('view', 'click') THEN 'recall' WHEN event_type IN ('purchase', 'error') THEN 'search' ELSE 'summary' END AS kind,
          CASE user_id % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'auto' ELSE 'mcp:tool' END AS origin, CAST(props AS {string}) AS query,
          CASE WHEN event_type IN ('view', 'click') THEN {array:event_id % 50 + 1, event_id * 7 % 50 + 1, user_id % 50 + 1} END AS result_ids
        FROM #events#""",
    "v_claims": """
        SELECT o_orderkey AS id, concat(c_name, ' placed an order on ', CASE WHEN o_orderkey % 3 = 0 THEN {iso:o_orderdate} ELSE {prose:o_orderdate} END,
            CASE WHEN o_orderkey % 5 = 0 THEN ' and comes back tomorrow' ELSE '' END, CASE WHEN o_orderkey % 13 = 0 THEN '. See pull request' WHEN o_orderkey % 17 = 0 THEN ' (quarantined)' ELSE '' END) AS fact,
          CASE o_orderkey % 4 WHEN 0 THEN concat(c_name, ' ordered on ', {prose:o_orderdate}, CASE WHEN o_orderkey % 8 = 0 THEN ', back tomorrow' ELSE '' END) WHEN 1 THEN concat(c_name, ' ordered on ', {iso:o_orderdate + INTERVAL 40 DAY})
            WHEN 2 THEN concat('someone ordered from ', CASE WHEN o_orderkey % 7 = 0 THEN c_name ELSE 'us' END) ELSE concat('pretend you are ', c_name, ' ordering on ', {prose:o_orderdate}) END AS source,
          o_custkey AS customer_id, {epoch:o_orderdate} AS created_at
        FROM #orders# JOIN #customer# ON o_custkey = c_custkey""",
    "v_lines": """
        SELECT id, CASE WHEN id % 23 = 0 THEN 'NONE' WHEN id % 19 = 0 THEN concat('I think that ', fact) ELSE
          concat(CASE WHEN id % 4 = 0 THEN '- ' ELSE '' END, 'NEW', CASE WHEN id % 6 = 0 THEN '' ELSE concat(' src=', id % 9) END, CASE WHEN id % 5 = 0 THEN '' ELSE concat(' importance=', id % 12) END,
            CASE WHEN id % 7 = 0 THEN '' ELSE concat(' event=', {iso:{when:created_at}}) END, CASE WHEN id % 10 = 0 THEN concat(' supersedes=', id % 50 + 1, ', ', id % 31 + 2) ELSE '' END, ': ', CASE WHEN id % 29 = 0 THEN 'short' ELSE fact END) END AS line,
          fact, source, created_at
        FROM #v_claims#""",
}

DIALECTS = {
    "spark": {
        "hash": r"substring(sha2(trim(regexp_replace(lower(X), '[^\\p{L}\\p{N}_]+', ' ')), 256), 1, 16)", "sha": "sha2(X, 256)", "epoch": "CAST(X AS DOUBLE)", "string": "STRING",
        "array": "array(X)", "iso": "date_format(X, 'yyyy-MM-dd')", "prose": "date_format(X, 'MMMM d, yyyy')", "when": "timestamp_seconds(X)",
    },
    "duck": {
        "hash": r"substring(sha256(trim(regexp_replace(lower(X), '[^\p{L}\p{N}_]+', ' ', 'g'))), 1, 16)", "sha": "sha256(X)", "epoch": "epoch(CAST(X AS TIMESTAMP))", "string": "VARCHAR",
        "array": "[X]", "iso": "strftime(X, '%Y-%m-%d')", "prose": "strftime(X, '%B %-d, %Y')", "when": "make_timestamp(CAST(X AS BIGINT) * 1000000)",
    },
}

# The same rows for Spark where a column is made of a text, or a vector met: hashes are made below the join, and as
# vec_id is the key of the embeddings, one join finds the vector. So texts move only where a query shows or
# searches them beside vectors, and the join is left out where no vector is asked for. The conversations' ids that
# attachments are dealt to are written first: the planner then knows how few bytes they are and doesn't move the texts.
SPARK_FORMS = {
    "v_facts": [
        ("{hash:d.text}", "d.hash"), ("CASE WHEN d.doc_id % 5 = 0 THEN p.embedding ELSE o.embedding END", "o.embedding"),
        ("FROM #documents# d LEFT JOIN #embeddings# o ON o.vec_id = d.doc_id LEFT JOIN #embeddings# p ON p.vec_id = d.doc_id - 1",
         "FROM (SELECT *, {hash:text} AS hash FROM #documents#) d LEFT JOIN (SELECT vec_id, first(embedding) AS embedding FROM #embeddings# GROUP BY vec_id) o ON o.vec_id = d.doc_id - CASE WHEN d.doc_id % 5 = 0 THEN 1 ELSE 0 END"),
    ],
    "v_attachments": [
        ("{sha:d.text}", "d.sha"),
        ("FROM (SELECT *, doc_id % (SELECT max(conv_id) + 1 FROM #conversations#) AS home FROM #documents#) d JOIN (SELECT DISTINCT conv_id FROM #conversations#) c",
         "FROM (SELECT *, {sha:text} AS sha, doc_id % (SELECT max(conv_id) + 1 FROM #homes#) AS home FROM #documents#) d JOIN #homes# c"),
    ],
}
WRITTEN = {"homes": "SELECT DISTINCT conv_id FROM #conversations#"}


def _spark_form(name: str) -> str:
    text = VIEWS[name]
    for old, new in SPARK_FORMS.get(name, []):
        if old not in text:
            raise ValueError(f"{name} no longer says {old}")
        text = text.replace(old, new)
    return text


def _spelled(text: str, engine: str) -> str:
    words = DIALECTS[engine]
    text = text.replace("{string}", words["string"])
    while m := re.search(r"\{(hash|sha|epoch|array|iso|prose|when):([^{}]*)\}", text):
        text = text[: m.start()] + words[m[1]].replace("X", m[2]).replace("{L}", "<L>").replace("{N}", "<N>") + text[m.end() :]
    return text.replace("<L>", "{L}").replace("<N>", "{N}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a given table."""
    if name in WRITTEN:
        return stored(_run(spark, sf_dir, WRITTEN[name]), name)
    if name not in VIEWS:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        for column, kind in df.dtypes:  # zone-less times are UTC in both engines
            df = df.withColumn(column, df[column].cast("timestamp")) if kind == "timestamp_ntz" else df
        return df
    return _run(spark, sf_dir, _spelled(_spark_form(name), "spark"))


def _run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    needs = sorted(set(re.findall(r"#(\w+)#", text)))
    frames = {n: view(spark, sf_dir, n) for n in needs}
    text = text.replace("{L}", "{{L}}").replace("{N}", "{{N}}")
    return spark.sql(re.sub(r"#(\w+)#", r"{\1}", text), **frames)


def duck(sql: str) -> str:
    """Oracle SQL with the views that it names (as v_...) in front."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for n in re.findall(r"\bv_\w+", text):
            if n in VIEWS and n not in wanted:
                need(VIEWS[n])
                wanted.append(n)

    need(sql)
    views = [f"{n} AS MATERIALIZED ({re.sub(r'#(\w+)#', r'\1', _spelled(VIEWS[n], 'duck'))})" for n in wanted]
    own = re.match(r"\s*WITH( RECURSIVE)?\s", sql)
    recursive = " RECURSIVE" if own and own[1] else ""
    rest = sql[own.end() :] if own else None
    if not views:
        return sql
    return f"WITH{recursive} {', '.join(views)}{', ' + rest if own else ' ' + sql}"
