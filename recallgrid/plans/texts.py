"""Queries over scalar functions: dates, hashes, text checks, miner lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixtures import ALLOWED
from ..functions import scoring, text, vector
from ..operators import mining, search, summary
from .registry import Views, add, query_vector
from .sqltext import DAY, FLAG, LABEL, SPEAKER, dates, phrases, proper, quoted, temporal, ungrounded

joined = lambda x: F.array_join(x, "|")
words = lambda x: f"array_to_string({x}, '|')"

add("scl_hash", lambda v: v("documents").select("doc_id", text.content_hash(F.col("text")).alias("h")), r"SELECT doc_id, substring(sha256(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'))), 1, 16) AS h FROM documents")
add("scl_ws", lambda v: v("documents").select("doc_id", F.sha2(text.normal_spaces(F.col("text")), 256).alias("h")), r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
add(
    "scl_clamp", lambda v: v("v_facts").select("id", scoring.clamp((F.col("id") % 15 - 2).cast("int"), 1, 9).alias("miner"), scoring.clamp((F.col("id") % 15 - 2).cast("int"), 1, 10).alias("owner")),
    "SELECT id, CAST(least(9, greatest(1, id % 15 - 2)) AS INT) AS miner, CAST(least(10, greatest(1, id % 15 - 2)) AS INT) AS owner FROM v_facts",
)
ISO = "CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN 'soon' WHEN 2 THEN '2024-02-30' ELSE {iso} END"
add(
    "scl_iso", lambda v: v("v_messages").select("id", scoring.to_epoch(F.expr(ISO.format(iso="date_format(timestamp_seconds(created_at), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"))).alias("epoch")),
    "SELECT id, CASE WHEN id % 5 > 2 THEN created_at END AS epoch FROM v_messages",
)
add(
    "scl_iso_fallback", lambda v: v("v_messages").select("id", F.coalesce(scoring.to_epoch(F.expr(ISO.format(iso="date_format(timestamp_seconds(created_at), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"))), F.lit(1.0)).alias("epoch")),
    "SELECT id, CASE WHEN id % 5 > 2 THEN created_at ELSE 1 END AS epoch FROM v_messages",
)
add("scl_day", lambda v: v("v_facts").select("id", scoring.day_of(F.col("event_date")).alias("day"), scoring.day_of(F.col("invalidated_at")).alias("ended")), f"SELECT id, {DAY('event_date')} AS day, {DAY('invalidated_at')} AS ended FROM v_facts")
add(
    "scl_target_k", lambda v: v("v_facts").select("id", scoring.target_clusters(F.col("id") - 1).alias("k")),
    "SELECT id, CAST(CASE WHEN id - 1 <= 6 THEN greatest(1, id - 1) ELSE least(14, greatest(6, round_even(sqrt((id - 1) / 2e0), 0))) END AS INT) AS k FROM v_facts",
)
add(
    "scl_section", lambda v: v("v_facts").select("id", summary.section_words(F.length("content")).alias("section"), summary.max_tokens(F.length("content")).alias("tokens")),
    "SELECT id, greatest(150, length(content) // 4) AS section, greatest(8000, 4 * length(content)) AS tokens FROM v_facts",
)
add("scl_round", lambda v: v("v_facts").select("id", *(F.round(F.col("event_date") / 7e6, k).alias(f"r{k}") for k in (1, 3, 4))), "SELECT id, round(event_date / 7e6, 1) AS r1, round(event_date / 7e6, 3) AS r3, round(event_date / 7e6, 4) AS r4 FROM v_facts")
add("vec_cos", lambda v: v("embeddings").select("vec_id", F.round(vector.cosine(F.col("embedding"), F.array(*map(F.lit, query_vector(v)))), 4).alias("sim")), "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 4) AS sim FROM embeddings")
add(
    "vec_unit", lambda v: v("embeddings").select("vec_id", F.round(vector.unit(F.col("embedding"))[0], 5).alias("first"), F.round(vector.norm(vector.unit(F.col("embedding"))), 6).alias("len")),
    "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first, 1e0 AS len FROM embeddings",
)


def _claim(name: str, found: Callable[[Column, Column], Column], sql: str) -> None:
    """A check of each claim's fact and source."""
    add(name, lambda v: v("v_claims").select("id", found(F.col("fact"), F.col("source")).alias("found")), f"SELECT id, {sql} AS found FROM v_claims")


_claim("txt_proper", lambda fact, source: joined(text.proper_nouns(fact, ALLOWED)), words(proper("fact")))
_claim("txt_ungrounded", lambda fact, source: joined(text.ungrounded_entities(fact, source, ALLOWED)), words(ungrounded("fact", "source")))
_claim("txt_dates", lambda fact, source: joined(F.array_sort(F.array_distinct(F.transform(text.explicit_dates(source), lambda d: F.format_string("%02d-%02d", d["month"], d["day"]))))), words(f"list_sort(list_distinct({dates('source')}))"))
_claim("txt_rel", lambda fact, source: joined(F.transform(text.relative_phrases(fact), F.lower)), words(phrases("fact")))
_claim("txt_temporal", lambda fact, source: joined(text.ungrounded_temporal(fact, source)), words(temporal("fact", "source")))
_claim("txt_trusted", lambda fact, source: text.source_trusted(source), f"NOT regexp_matches(source, {quoted('(?i)' + text.PERSONA)})")
_claim("txt_sysmeta", lambda fact, source: text.is_system_meta(fact), f"regexp_matches(fact, {quoted('(?i)' + text.SYSTEM_META)})")
_claim("txt_inscope", lambda fact, source: text.in_scope(fact), f"NOT regexp_matches(fact, {quoted('(?i)' + text.SYSTEM_META)})")
_claim("txt_builder", lambda fact, source: text.is_builder_process(fact), f"regexp_matches(fact, {quoted('(?i)' + text.BUILDER_PROCESS)})")
_claim(
    "txt_check", lambda fact, source: joined(text.check_flags(fact, source, ALLOWED)),
    f"""concat_ws('|', CASE WHEN len({ungrounded("fact", "source")}) > 0 THEN 'grounding: ' || array_to_string({ungrounded("fact", "source")}, ', ') || ' not in source chat' END,
      CASE WHEN len({temporal("fact", "source")}) > 0 THEN 'temporal: ' || array_to_string({temporal("fact", "source")}, ', ') || ' not stated in source chat' END,
      CASE WHEN regexp_matches(source, {quoted("(?i)" + text.PERSONA)}) THEN 'source-trust: chat contains roleplay/persona/dossier framing' END)""",
)
add("txt_speaker", lambda v: v("v_messages").select("id", text.speaker_class(F.col("speaker")).alias("c")), f"SELECT id, {SPEAKER} AS c FROM v_messages")
add("txt_guest", lambda v: v("v_messages").select("id", text.guest_name(F.col("speaker")).alias("guest")), f"SELECT id, CASE WHEN {SPEAKER} = 'guest' THEN trim(split_part(speaker, ':', 2)) END AS guest FROM v_messages")
add("txt_spk_flag", lambda v: v("v_messages").select("id", text.speaker_flag(F.col("speaker")).alias("flag")), f"SELECT id, {FLAG} AS flag FROM v_messages")
add("txt_label", lambda v: v("v_messages").select("id", text.speaker_label(F.col("speaker"), "Alex").alias("label")), f"SELECT id, {LABEL} AS label FROM v_messages")
add("txt_origin", lambda v: v("v_facts").select("id", text.valid_origin(F.when(F.col("id") % 3 == 0, F.col("content")).otherwise(F.col("origin_agent"))).alias("fit")), "SELECT id, regexp_full_match(CASE WHEN id % 3 = 0 THEN content ELSE origin_agent END, '[a-z][a-z0-9:_-]{0,31}') AS fit FROM v_facts")
GOOD_LINE = "id % 23 <> 0 AND id % 19 <> 0 AND id % 29 <> 0"
add("txt_line", lambda v: mining.parse_lines(v("v_lines")).select("id", F.col("fact"), "drop"), f"""SELECT id, trim(fact) AS fact, CASE WHEN regexp_matches(fact, {quoted('(?i)' + text.SYSTEM_META)}) THEN 'system-meta'
    WHEN regexp_matches(fact, {quoted('(?i)' + text.BUILDER_PROCESS)}) THEN 'builder-process' END AS "drop" FROM v_lines WHERE {GOOD_LINE}""")
add(
    "txt_attrs", lambda v: mining.parse_lines(v("v_lines")).select("id", "src", "importance", "event", joined(F.col("supersedes").cast("array<string>")).alias("supersedes")),
    f"""SELECT id, CASE WHEN id % 6 <> 0 THEN CAST(id % 9 AS INT) END AS src, CASE WHEN id % 5 <> 0 THEN CAST(least(9, greatest(1, id % 12)) AS INT) END AS importance, CASE WHEN id % 7 <> 0 THEN {DAY("created_at")} END AS event,
      CASE WHEN id % 10 = 0 THEN (id % 50 + 1) || '|' || (id % 31 + 2) ELSE '' END AS supersedes FROM v_lines WHERE {GOOD_LINE}""",
)
add(
    "txt_event", lambda v: mining.parse_lines(v("v_lines")).select("id", mining.grounded_event(F.col("event"), F.col("source"), F.col("created_at")).alias("at")),
    f"""SELECT id, CASE WHEN id % 7 <> 0 AND (contains(source, {DAY("created_at")}) OR contains(source, strftime(make_timestamp(CAST(created_at AS BIGINT) * 1000000), '%B %-d, %Y'))) THEN created_at END AS at
    FROM v_lines WHERE {GOOD_LINE}""",
)
