"""Pieces of oracle SQL that several queries share."""

from __future__ import annotations

from ..fixtures import ALLOWED, NOW, QUERY, QUERY_VECTOR
from ..functions import scoring, text

VALID = "invalidated_at IS NULL AND quarantined_at IS NULL"
FACT = "id, source, origin_agent, conversation_id, event_date, confidence, importance, content_hash, invalidated_at, superseded_by, quarantined_at, quarantine_reason, review_dismissed_at"
FACT_COLUMNS = FACT.split(", ")
TS = "coalesce(nullif(event_date, 0), nullif(created_at, 0))"
REC = f"CASE WHEN {TS} IS NULL THEN 0e0 ELSE greatest(0e0, 1 - greatest(0e0, {NOW}e0 - {TS}) / 86400 / 1095) END"
KW = " + ".join(f"contains(lower(content), '{w}')::INT" for w in scoring.query_words(QUERY))
SEM = f"CASE WHEN embedding IS NULL THEN 0e0 ELSE list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {QUERY_VECTOR})) END"
SCORED = f"""scored AS (SELECT *, sem + 0.12e0 * least(kw, 3) + 0.05e0 * (invalidated_at IS NULL)::INT + 0.10e0 * rec AS score, sem > 0.25e0 OR kw > 0 AS cand
  FROM (SELECT *, {SEM} AS sem, {KW} AS kw, {REC} AS rec FROM v_facts) q)"""
IMP = "coalesce(nullif(importance, 0), 5)"
WEIGHT = f"{IMP} / 10e0 * exp(-greatest(0e0, ({NOW}e0 - coalesce({TS}, 0)) / 86400) / (CASE WHEN {IMP} >= 10 THEN 'inf'::DOUBLE ELSE 30 * (0.5e0 + {IMP} / 4e0) END))"


def fold(source: str, name: str = "fold", limit: int | None = None) -> str:
    """A recursive expression that collapses source(rn, id, score, h, e) in order of rn."""
    over = f"WHEN n >= {limit} THEN 'over' " if limit is not None else ""
    return f"""{name}(rn, n, hs, vs, id, score, state) AS (
  SELECT 0::BIGINT, 0, []::VARCHAR[], []::DOUBLE[][], NULL::BIGINT, NULL::DOUBLE, ''
  UNION ALL SELECT rn, n + (state = 'kept')::INT, CASE WHEN state = 'kept' AND h <> '' THEN list_append(hs, h) ELSE hs END, CASE WHEN state = 'kept' AND e IS NOT NULL THEN list_append(vs, e) ELSE vs END, id, score, state
  FROM (SELECT c.rn, f.n, f.hs, f.vs, c.id, c.score, c.h, c.e, CASE {over}WHEN c.h <> '' AND list_contains(f.hs, c.h) THEN 'dup'
    WHEN c.e IS NOT NULL AND len(list_filter(f.vs, lambda v: list_cosine_similarity(v, c.e) > 0.93e0)) > 0 THEN 'collapsed' ELSE 'kept' END AS state
    FROM {name} f JOIN {source} c ON c.rn = f.rn + 1) s)"""


COLLAPSED = "coalesce(content_hash, '') AS h, embedding::DOUBLE[] AS e"
DAY = lambda x: f"coalesce(strftime(make_timestamp(CAST(nullif({x}, 0) AS BIGINT) * 1000000), '%Y-%m-%d'), '?')"
TAG = "CASE WHEN origin_agent = 'user' THEN 'direct' WHEN source = 'chat' THEN 'mined' ELSE coalesce(nullif(origin_agent, ''), 'unknown') END"
STATUS = "CASE WHEN invalidated_at IS NOT NULL THEN 'superseded' WHEN quarantined_at IS NOT NULL AND review_dismissed_at IS NOT NULL THEN 'dismissed' WHEN quarantined_at IS NOT NULL THEN 'pending review' ELSE 'approved' END"
SPEAKER = """CASE WHEN trim(speaker) = 'user' THEN 'owner' WHEN NOT contains(trim(speaker), ':') THEN CASE WHEN trim(speaker) = '' THEN 'unrecognised' ELSE 'model' END
  WHEN lower(trim(split_part(speaker, ':', 1))) = 'guest' THEN CASE WHEN lower(trim(split_part(speaker, ':', 2))) IN ('', 'unknown') THEN 'guest-unknown' ELSE 'guest' END ELSE 'unrecognised' END"""
FLAG = f"""CASE {SPEAKER} WHEN 'guest' THEN 'guest-attribution: stated by guest ' || trim(split_part(speaker, ':', 2)) || ', not the owner'
  WHEN 'guest-unknown' THEN 'guest-attribution: speaker unidentified (diarization could not attribute this turn confidently)'
  WHEN 'unrecognised' THEN 'speaker-trust: unrecognised speaker class ''' || speaker || ''', treated as untrusted' END"""
LABEL = f"CASE WHEN speaker = 'user' THEN 'Alex' WHEN {SPEAKER} = 'guest' THEN trim(split_part(speaker, ':', 2)) || ' (guest)' WHEN {SPEAKER} = 'guest-unknown' THEN 'Unidentified speaker (guest)' ELSE speaker END"
KIND = "CASE WHEN mime LIKE 'image/%' THEN 'image' WHEN extracted_text <> '' THEN 'text' ELSE 'binary' END"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


KNOWN = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS + [a.lower() for a in ALLOWED]) + "]"


def proper(x: str) -> str:
    caps = text.CAPITALISED
    bare = f"list_transform(regexp_extract_all({x}, {quoted(caps)}), lambda p: trim(trim(p), '.,;:!?''\"'))"
    return f"list_filter({bare}, lambda p: p <> '' AND NOT list_contains({KNOWN}, lower(p)) AND len(list_filter(string_split_regex(lower(p), '\\s+'), lambda w: NOT list_contains({KNOWN}, w))) > 0)"


def ungrounded(fact: str, source: str) -> str:
    return f"list_filter({proper(fact)}, lambda p: NOT contains(lower({source}), lower(p)) AND len(list_filter(string_split_regex(lower(p), '[\\s\\-/.]+'), lambda w: length(w) >= 4 AND contains(lower({source}), w))) = 0)"


def dates(x: str) -> str:
    """MM-DD of the dates written in x. RE2 and Java agree on these patterns."""
    g = lambda pattern, k: f"regexp_extract_all({x}, {quoted(pattern)}, {k})"
    months = "[" + ", ".join(f"'{m}'" for m in text.MONTHS) + "]"
    number = lambda m: f"list_position({months}, lower(substring({m}, 1, 3)))"
    one = lambda y, m, d: f"CASE WHEN try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE) IS NOT NULL THEN printf('%02d-%02d', {m}, {d}) END"
    year = lambda y: f"CASE WHEN {y} = '' THEN 2000 ELSE CAST({y} AS INT) END"
    iso = f"list_transform(list_zip({g(text.ISO_DATE, 1)}, {g(text.ISO_DATE, 2)}, {g(text.ISO_DATE, 3)}), lambda t: {one('CAST(t[1] AS INT)', 'CAST(t[2] AS INT)', 'CAST(t[3] AS INT)')})"
    mdy = f"list_transform(list_zip({g(text.MONTH_DAY, 1)}, {g(text.MONTH_DAY, 2)}, {g(text.MONTH_DAY, 3)}), lambda t: {one(year('t[3]'), number('t[1]'), 'CAST(t[2] AS INT)')})"
    dmy = f"list_transform(list_zip({g(text.DAY_MONTH, 1)}, {g(text.DAY_MONTH, 2)}, {g(text.DAY_MONTH, 3)}), lambda t: {one(year('t[3]'), number('t[2]'), 'CAST(t[1] AS INT)')})"
    return f"list_filter(list_concat(list_concat({iso}, {mdy}), {dmy}), lambda d: d IS NOT NULL)"


def phrases(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {quoted('(?i)' + text.RELATIVE_TIME)}, 1), lambda p: lower(p))"


def temporal(fact: str, source: str) -> str:
    return f"list_concat(list_filter({dates(fact)}, lambda d: NOT list_contains({dates(source)}, d)), list_filter({phrases(fact)}, lambda p: NOT list_contains({phrases(source)}, p)))"

FILE_BODIES = "(SELECT a.*, coalesce(nullif(a.extracted_text, ''), c.caption, '') AS body FROM v_attachments a LEFT JOIN v_captions c ON c.attachment_id = a.id)"
BODIES = f"""u AS (SELECT m.* FROM v_messages m JOIN v_conversations k ON k.id = m.conversation_id WHERE m.id > k.mined_upto),
b AS (SELECT conversation_id, message_external_id AS external_id, CAST(sum(length(body)) AS BIGINT) AS chars, string_agg(chr(10) || '[Attached file: ' || filename || ']' || chr(10) || body, '' ORDER BY id) AS added
  FROM {FILE_BODIES} x WHERE body <> '' GROUP BY conversation_id, message_external_id),
p AS (SELECT u.*, least(length(content) + coalesce(chars, 0), 20000) AS view_len, row_number() OVER (PARTITION BY u.conversation_id ORDER BY u.id) AS rn,
    CASE WHEN length(content || coalesce(added, '')) > 20000 THEN substring(content || coalesce(added, ''), 1, 20000) || ' … [truncated]' ELSE content || coalesce(added, '') END AS body
  FROM u LEFT JOIN b USING (conversation_id, external_id))"""


def windowed(most: int, chars: int) -> str:
    """p with its window_no and msg_no, as placed: the packing runs on row by row of a conversation."""
    full = f"(f.n >= {most} OR f.c + p.view_len > {chars})"
    return f"""{BODIES},
f(conversation_id, rn, id, w, n, c) AS (SELECT conversation_id, rn, id, 1, 1, view_len FROM p WHERE rn = 1
  UNION ALL SELECT p.conversation_id, p.rn, p.id, f.w + {full}::INT, CASE WHEN {full} THEN 1 ELSE f.n + 1 END, CASE WHEN {full} THEN p.view_len ELSE f.c + p.view_len END
  FROM f JOIN p ON p.conversation_id = f.conversation_id AND p.rn = f.rn + 1),
placed AS (SELECT p.*, f.w AS window_no, f.n AS msg_no FROM p JOIN f USING (conversation_id, id))"""
