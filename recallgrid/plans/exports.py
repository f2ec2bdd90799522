"""Queries over chat exports: JSON text made from the tables, read with the export's schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixtures import NOW
from ..functions import vector
from ..operators.tables import new_path
from ..sources import readers, snapshots
from ..sources.arrays import array_objects
from .registry import Views, add

# An export object holds the messages of one range of ids, so that no object grows with a conversation.
RANGE = f"floor(m.id / {readers.MAX_MESSAGES}e0)"
INPUT = "named_struct('path', {path}, 'title', {title}, 'id', {id}, 'content', {content}, 'old_str', {old}, 'new_str', {new})"
BLANK = dict.fromkeys(("path", "title", "id", "content", "old", "new"), "''")
ART = {"title": "CASE WHEN id % 2 = 1 THEN concat('Art ', id) ELSE '' END", "id": "CASE WHEN id % 4 = 0 THEN '' ELSE concat('k', id) END", "content": "CASE WHEN id % 3 = 0 THEN concat(content, chr(10)) ELSE '' END", "old": "CASE WHEN id % 5 = 0 THEN 'was' END", "new": "CASE WHEN id % 10 = 0 THEN 'is' END"}
READ_INPUT = {"path": "CASE WHEN id % 5 = 0 THEN '' WHEN id % 2 = 0 THEN concat(' dir/a', chr(9), '  b ') ELSE ' ' END", "title": "concat('T', id)"}
BLOCKS = f"""filter(array(
  CASE WHEN id % 6 <> 5 THEN named_struct('type', 'text', 'text', concat('  ', content, chr(10)), 'thinking', '', 'name', '', 'input', {INPUT.format(**BLANK)}) END,
  CASE WHEN id % 4 = 0 THEN named_struct('type', 'thinking', 'text', '', 'thinking', concat(' about ', id), 'name', '', 'input', {INPUT.format(**BLANK)}) END,
  CASE WHEN id % 3 = 0 THEN named_struct('type', 'tool_use', 'text', '', 'thinking', '', 'name', CASE WHEN id % 9 = 0 THEN '' ELSE 'read' END, 'input', {INPUT.format(**BLANK | READ_INPUT)}) END,
  CASE WHEN id % 5 = 0 THEN named_struct('type', 'tool_result', 'text', 'what came of it', 'thinking', '', 'name', '', 'input', {INPUT.format(**BLANK)}) END,
  CASE WHEN id % 11 = 0 THEN named_struct('type', 'tool_use', 'text', '', 'thinking', '', 'name', 'artifacts', 'input', {INPUT.format(**BLANK | ART)}) END), b -> b IS NOT NULL)"""
MESSAGE = f"""named_struct('uuid', external_id, 'sender', CASE WHEN id % 50 = 0 THEN '' WHEN id % 2 = 1 THEN 'human' WHEN id % 14 = 0 THEN 'robot' ELSE 'assistant' END,
  'created_at', CASE WHEN id % 9 <> 0 THEN date_format(timestamp_seconds(created_at), "yyyy-MM-dd'T'HH:mm:ss'Z'") END, 'text', CASE WHEN id % 12 = 5 THEN concat(' plain ', id) ELSE ' ' END, 'content', {BLOCKS},
  'attachments', CASE WHEN id % 8 = 0 THEN array(named_struct('file_name', CASE WHEN id % 16 = 0 THEN '' ELSE concat('a', id, '.txt') END, 'extracted_content', CASE WHEN id % 24 = 0 THEN ' ' ELSE concat(content, ' ') END)) ELSE array() END,
  'files', CASE WHEN id % 7 = 0 THEN array(named_struct('file_name', CASE WHEN id % 21 = 0 THEN '' ELSE concat('f', id, '.png') END)) END) AS message"""
# The same messages, as an import must read them: blocks in order, blank lines between, names that stand in for missing ones.
SPEAKER = "CASE WHEN m.id % 50 = 0 THEN 'unknown' WHEN m.id % 2 = 1 THEN 'user' WHEN m.id % 14 = 0 THEN 'robot' ELSE 'claude' END"
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}|{WHITE}$', '', 'g')"


SAID = f"""concat_ws(chr(10) || chr(10), CASE WHEN m.id % 6 <> 5 THEN nullif({stripped('m.content')}, '') END, CASE WHEN m.id % 4 = 0 THEN '[thinking]' || chr(10) || 'about ' || m.id END,
  CASE WHEN m.id % 3 = 0 THEN '[tool: ' || CASE WHEN m.id % 9 = 0 THEN 'tool' ELSE 'read' END || CASE WHEN m.id % 5 = 0 THEN ' T' || m.id WHEN m.id % 2 = 0 THEN ' dir/a b' ELSE '' END || ']' END,
  CASE WHEN m.id % 11 = 0 THEN '[tool: artifacts' || CASE WHEN m.id % 2 = 1 THEN ' Art ' || m.id WHEN m.id % 4 <> 0 THEN ' k' || m.id ELSE '' END || ']' END,
  CASE WHEN m.id % 12 = 5 AND m.id % 11 <> 0 THEN 'plain ' || m.id END,
  CASE WHEN m.id % 7 = 0 AND m.id % 21 <> 0 THEN '[file: f' || m.id || '.png]' END, CASE WHEN m.id % 8 = 0 THEN '[attachment: ' || CASE WHEN m.id % 16 = 0 THEN 'attachment' ELSE 'a' || m.id || '.txt' END || ']' END)"""
ART_TEXT = lambda title, content, old, new: stripped(f"concat_ws(chr(10) || chr(10), '# ' || nullif({title}, ''), nullif({content}, ''), CASE WHEN coalesce({old}, '') <> '' OR coalesce({new}, '') <> '' THEN '[update]' || chr(10) || '--- old' || chr(10) || coalesce({old}, '') || chr(10) || '--- new' || chr(10) || coalesce({new}, '') END)")
MADE = ART_TEXT("CASE WHEN m.id % 2 = 1 THEN 'Art ' || m.id END", "CASE WHEN m.id % 3 = 0 THEN m.content || chr(10) END", "CASE WHEN m.id % 5 = 0 THEN 'was' END", "CASE WHEN m.id % 10 = 0 THEN 'is' END")
READ = f"""SELECT c.external_id || '-' || CAST({RANGE} AS BIGINT) AS conversation, c.title AS name, m.external_id, {SPEAKER} AS speaker, {SAID} AS content,
  CASE WHEN m.id % 9 <> 0 THEN m.created_at ELSE c.created_at END AS created_at,
  list_filter([CASE WHEN m.id % 11 = 0 AND {MADE} <> '' THEN CASE WHEN m.id % 4 = 0 THEN 'artifact' ELSE 'k' || m.id END || '.txt:' || sha256({MADE}) END,
    CASE WHEN m.id % 8 = 0 AND m.id % 24 <> 0 AND {stripped('m.content')} <> '' THEN CASE WHEN m.id % 16 = 0 THEN 'attachment' ELSE 'a' || m.id || '.txt' END || ':' || sha256({stripped('m.content')}) END], lambda x: x IS NOT NULL) AS files
  FROM v_messages m JOIN v_conversations c ON c.id = m.conversation_id"""
KEPT = "content <> '' OR len(files) > 0"


def _conversation_texts(v: Views) -> DataFrame:
    """value: the JSON text of each of an export's conversations."""
    messages = v("v_messages").alias("m").selectExpr("conversation_id", f"CAST({RANGE} AS BIGINT) AS range", "id", MESSAGE)
    nested = messages.groupBy("conversation_id", "range").agg(F.array_sort(F.collect_list(F.struct("id", "message"))).alias("all"))
    homes = v("v_conversations").select(F.col("id").alias("conversation_id"), "external_id", F.col("title").alias("name"), F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    return nested.join(homes, "conversation_id").select(F.to_json(F.struct(F.concat_ws("-", "external_id", "range").alias("uuid"), "name", "created_at", F.col("all.message").alias("chat_messages"))).alias("value"))


def _conversations(v: Views) -> DataFrame:
    """An export's conversations, by way of their JSON text."""
    return readers.export_rows(_conversation_texts(v), readers.EXPORT)


def _projects(v: Views) -> DataFrame:
    """A project for each customer, with the sources of its claims as documents."""
    doc = F.struct(F.col("id").cast("string").alias("uuid"), F.expr("CASE WHEN id % 6 = 0 THEN '' ELSE concat('d', id, '.md') END").alias("filename"), F.expr("CASE WHEN id % 7 = 0 THEN ' ' ELSE concat(source, ' ') END").alias("content"), F.expr("""CASE WHEN id % 2 = 0 THEN date_format(timestamp_seconds(created_at), "yyyy-MM-dd'T'HH:mm:ss'Z'") END""").alias("created_at"))
    head = [F.col("customer_id").cast("string").alias("uuid"), F.expr("CASE WHEN customer_id % 5 = 0 THEN '' ELSE concat('Named ', customer_id) END").alias("name"), F.expr("CASE WHEN customer_id % 3 = 0 THEN '' ELSE concat('about ', customer_id) END").alias("description"), F.expr("CASE WHEN customer_id % 2 = 0 THEN 'Be brief.' ELSE '' END").alias("prompt_template")]
    texts = v("v_claims").groupBy("customer_id").agg(F.collect_list(doc).alias("docs")).select(F.to_json(F.struct(*head, "docs")).alias("value"))
    return readers.export_rows(texts, readers.PROJECT)


def _as_arrays(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of one JSON array from a task's objects."""
    before = "["
    for f in frames:
        for text in f["value"]:
            yield pd.DataFrame({"value": [before + text]})
            before = ","
    yield pd.DataFrame({"value": ["[]" if before == "[" else "]"]})


def _written(v: Views) -> DataFrame:
    """The export's conversations, by way of files that hold an array each, read by byte ranges."""
    texts = _conversation_texts(v)
    path = new_path(texts.sparkSession, "export")
    texts.mapInPandas(_as_arrays, "value string").write.text(path)
    return readers.export_rows(array_objects(texts.sparkSession, path), readers.EXPORT)


add("src_export", lambda v: _written(v).select("uuid", "name", F.size("chat_messages").alias("messages")), f"SELECT conversation AS uuid, name, count(*) AS messages FROM ({READ}) x GROUP BY conversation, name")
def _file_names() -> Column:
    """Names and digests of a message's files as one text."""
    return F.array_join(F.transform("attachments", lambda f: F.concat(f["filename"], F.lit(":"), F.sha2(f["text"], 256))), " ").alias("files")


add(
    "src_export_msg", lambda v: readers.export_messages(_conversations(v), NOW).select("external_id", F.length("content").alias("chars"), F.sha2("content", 256).alias("sha"), _file_names()),
    f"SELECT external_id, length(content) AS chars, sha256(content) AS sha, array_to_string(files, ' ') AS files FROM ({READ}) x WHERE {KEPT}",
)
add(
    "src_export_conv", lambda v: readers.export_messages(_conversations(v), NOW).select("conversation", "name", "external_id", "speaker", "created_at"),
    f"SELECT conversation, name, external_id, speaker, created_at FROM ({READ}) x WHERE {KEPT}",
)
add(
    "agg_import", lambda v: readers.import_counts(_conversations(v), readers.export_messages(_conversations(v), NOW)),
    f"""SELECT count(*) FILTER (kept > 0) AS conversations, count(*) FILTER (kept = 0) AS empty_conversations, CAST(sum(kept) AS BIGINT) AS messages, CAST(sum(n - kept) AS BIGINT) AS empty_messages, CAST(sum(attached) AS BIGINT) AS attached
    FROM (SELECT conversation, count(*) AS n, count(*) FILTER ({KEPT}) AS kept, sum(len(list_distinct(list_transform(files, lambda f: split_part(f, ':', 2))))) AS attached FROM ({READ}) x GROUP BY conversation) y""",
)


def _block(**fields: str) -> str:
    """JSON text of a content block, read with the export's schema."""
    given = ", ".join(f"'{k}', {x}" for k, x in fields.items())
    return f"to_json(named_struct('type', 'tool_use', 'name', CASE WHEN id % 3 = 1 THEN '' ELSE concat('t', id % 3) END, 'input', named_struct({given})))"


add(
    "src_export_tool",
    lambda v: v("v_attachments").select("id", readers.tool_marker(F.from_json(F.expr(_block(path="CASE WHEN id % 3 = 0 THEN '' END", title="CASE WHEN id % 2 = 0 THEN extracted_text ELSE ' ' END", url="concat('https://example.org/', id)")), readers.BLOCK)).alias("marker")),
    f"""SELECT id, '[tool: ' || CASE WHEN id % 3 = 1 THEN 'tool' ELSE 't' || id % 3 END || CASE WHEN arg <> '' THEN ' ' || arg ELSE '' END || ']' AS marker
    FROM (SELECT id, substring({stripped(f"regexp_replace(CASE WHEN id % 2 = 0 THEN coalesce(nullif(extracted_text, ''), 'https://example.org/' || id) ELSE ' ' END, '{WHITE}', ' ', 'g')")}, 1, 120) AS arg FROM v_attachments) x""",
)
add(
    "src_export_art",
    lambda v: v("v_attachments").select("id", readers.artifact_text(F.from_json(F.expr(_block(title="CASE WHEN id % 3 = 0 THEN '' ELSE filename END", content="extracted_text", old_str="CASE WHEN id % 4 = 0 THEN 'was' END", new_str="CASE WHEN id % 8 = 0 THEN 'is' END")), readers.BLOCK)).alias("t")).select("id", F.length("t").alias("chars"), F.sha2("t", 256).alias("sha")),
    f"""SELECT id, length(t) AS chars, sha256(t) AS sha FROM (SELECT id, {ART_TEXT("CASE WHEN id % 3 <> 0 THEN filename END", "extracted_text", "CASE WHEN id % 4 = 0 THEN 'was' END", "CASE WHEN id % 8 = 0 THEN 'is' END")} AS t FROM v_attachments) x""",
)
add(
    "src_export_proj", lambda v: readers.project_messages(_projects(v), NOW).select("conversation", "name", "external_id", "speaker", "content", "created_at", _file_names()),
    f"""WITH p AS (SELECT DISTINCT customer_id AS k, concat_ws(chr(10) || chr(10), '[project]' || CASE WHEN customer_id % 5 = 0 THEN '' ELSE ' Named ' || customer_id END, CASE WHEN customer_id % 3 <> 0 THEN 'about ' || customer_id END,
      CASE WHEN customer_id % 2 = 0 THEN '[prompt template]' || chr(10) || 'Be brief.' END) AS head, 'Project: ' || CASE WHEN customer_id % 5 = 0 THEN '' ELSE 'Named ' || customer_id END AS name FROM v_claims)
    SELECT 'project-' || k AS conversation, name, 'project-' || k AS external_id, 'user' AS speaker, head AS content, {NOW}e0 AS created_at, '' AS files FROM p
    UNION ALL SELECT 'project-' || customer_id, p.name, CAST(id AS VARCHAR), 'user', '[project doc: ' || CASE WHEN id % 6 = 0 THEN '' ELSE 'd' || id || '.md' END || ']', CASE WHEN id % 2 = 0 THEN c.created_at ELSE {NOW}e0 END,
      CASE WHEN id % 7 = 0 THEN '' ELSE CASE WHEN id % 6 = 0 THEN 'doc.txt' ELSE 'd' || id || '.md' END || ':' || sha256(source) END FROM v_claims c JOIN p ON k = customer_id""",
)
add(
    "src_export_mem",
    lambda v: readers.memory_messages(readers.memory_rows(v("v_facts").select("id", F.expr("to_json(array(map('note', CASE WHEN id % 10 = 0 THEN '  ' ELSE content END, 'other', CASE WHEN id % 4 = 0 THEN concat(chr(10), 'fact ', id, ' ') ELSE '' END)))").alias("value")), "id")).select("external_id", "speaker", F.length("content").alias("chars"), F.sha2("content", 256).alias("sha")),
    f"""SELECT 'memory-' || (row_number() OVER (ORDER BY id, k) - 1) AS external_id, 'system' AS speaker, length(t) AS chars, sha256(t) AS sha FROM (SELECT id, 0 AS k, {stripped("CASE WHEN id % 10 = 0 THEN '' ELSE content END")} AS t FROM v_facts
      UNION ALL SELECT id, 1, 'fact ' || id FROM v_facts WHERE id % 4 = 0) x WHERE t <> ''""",
)
add(
    "src_export_guard",
    lambda v: readers.not_imported(v("customer").select(F.concat(F.lit("acc-"), "c_custkey").alias("uuid")), v("v_claims").select(F.expr("concat(CASE WHEN id % 3 = 0 THEN 'import:acc-' ELSE 'theme:acc-' END, customer_id)").alias("key"))),
    "SELECT 'acc-' || c_custkey AS uuid FROM customer WHERE c_custkey NOT IN (SELECT customer_id FROM v_claims WHERE id % 3 = 0)",
)


def _ledger(v: Views, by_id: bool = False) -> tuple[DataFrame, str]:
    """The facts, and a folder of tables that hold them; by_id: near ids together, as a ledger grows."""
    facts = v("v_facts")
    facts = _near(facts) if by_id else facts
    spark, folder = facts.sparkSession, new_path(facts.sparkSession, "tables")
    readers.create_tables(spark, folder)
    facts.to(readers.read_table(spark, folder, "facts").schema).write.mode("append").parquet(f"{folder}/facts")
    return facts, folder


def _near(facts: DataFrame) -> DataFrame:
    return facts.repartition(F.floor(F.col("id") / RANGE_IDS))


def _backed_up(v: Views) -> DataFrame:
    """The facts of a snapshot of tables that hold the ledger."""
    facts, folder = _ledger(v)
    return snapshots.read_snapshot(facts.sparkSession, snapshots.backup(facts.sparkSession, folder, f"{folder}-backups", "20240101-000000"), "facts")


RANGE_IDS = 1000


def _ticked(v: Views) -> DataFrame:
    """Ranges of a timer's second snapshot of facts, after one with nothing changed and one with new facts; fresh: not in the first."""
    facts, folder = _ledger(v, by_id=True)
    spark, target = facts.sparkSession, f"{folder}-backups"
    first = snapshots.tick(spark, folder, target, "20240101-000000", range_ids=RANGE_IDS)
    idle = snapshots.tick(spark, folder, target, "20240101-010000", range_ids=RANGE_IDS)
    new = _near(v("v_facts").where("id % 17 = 0").withColumn("id", F.col("id") * 3))
    new.to(readers.read_table(spark, folder, "facts").schema).write.mode("append").parquet(f"{folder}/facts")
    then = snapshots.manifest(spark, snapshots.tick(spark, folder, target, "20240101-020000", range_ids=RANGE_IDS)).where("table = 'facts'")
    same = snapshots.manifest(spark, first).select("table", "range", "written").withColumn("same", F.lit(True))
    return then.join(same, ["table", "range", "written"], "left").select("range", "rows", F.col("same").isNull().alias("fresh"), F.lit(idle is None).alias("idle"))


add("snk_backup", lambda v: _backed_up(v).select("id", "content_hash", "importance", F.size("embedding").alias("dims")), "SELECT id, content_hash, importance, len(embedding) AS dims FROM v_facts")
add(
    "str_backup", _ticked,
    f"""SELECT CAST(floor(id / {RANGE_IDS}e0) AS BIGINT) AS range, count(*) AS rows, bool_or(new) AS fresh, true AS idle
    FROM (SELECT id, false AS new FROM v_facts UNION ALL SELECT id * 3, true FROM v_facts WHERE id % 17 = 0) x GROUP BY 1""",
)
add(
    "vec_pack", lambda v: v("embeddings").select("vec_id", vector.unpack(vector.pack(F.col("embedding"))).alias("e")).select("vec_id", F.size("e").alias("dims"), F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a * 0.5 + x), 5).alias("folded")),
    "SELECT vec_id, len(embedding) AS dims, round(list_reduce(list_prepend(0e0, list_transform(embedding, lambda x: CAST(x AS DOUBLE))), lambda a, x: a * 0.5e0 + x), 5) AS folded FROM embeddings",
)
