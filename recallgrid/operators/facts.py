"""The fact table: scans, listings, the write gate and state transitions as pure DataFrame functions.

Nothing is updated in place: a transition takes a table and returns the next one. New ids are
max(id) + position in the batch, so one batch is written at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scoring, text
from .tables import stored

MIN_FACT, MAX_FACT = 8, 10_000
LIMITS = {"search": (1, 500), "recall": (1, 50), "facts": (1, 1000), "attachments": (1, 1000), "tail": (0, 100)}


def checked_limit(kind: str, limit: int) -> int:
    low, high = LIMITS[kind]
    if not low <= limit <= high:
        raise ValueError(f"{kind} limit must be within {low} and {high}")
    return limit


def parse_id_query(query: str | None) -> list[int] | None:
    """Ids of a query like "#12, 34 56", else None."""
    m = re.match(r"^#\s*(\d[\d,\s]*)$", (query or "").strip())
    return [int(x) for x in re.split(r"[,\s]+", m[1]) if x] if m else None


def with_status(facts: DataFrame, status: str) -> DataFrame:
    """Rows in a state; any other word than valid, superseded and quarantined is no filter."""
    states = {"valid": schema.valid, "superseded": schema.superseded, "quarantined": schema.quarantined}
    return facts.where(states[status]()) if status in states else facts


def like(column: Column, query: str) -> Column:
    """Substring test without case; % and _ of the query are live wildcards.

    What % parts is found piece by piece, each where it comes first; a pattern that goes back to earlier pieces
    would take the square of a text's length, or more.
    """
    pieces = [p for p in query.split("%") if p]
    if "\\" in query or len(pieces) < 2 and "_" not in query:  # escapes are left to ilike
        return column.ilike(f"%{query}%")
    spelled = ("".join("." if c == "_" else f"\\x{{{ord(c):x}}}" for c in p.lower()) for p in pieces)
    return F.lower(column).rlike(r"(?s)\A" + "".join(f"(?>.*?{p})" for p in spelled))


def list_facts(facts: DataFrame, status: str = "valid", query: str | None = None, limit: int = 100) -> DataFrame:
    """Newest ids first; a list of ids is never cut by the limit."""
    out, ids = with_status(facts, status), parse_id_query(query)
    if ids:
        out, limit = out.where(F.col("id").isin(ids)), max(limit, len(ids))
    elif query:
        out = out.where(like(F.col("content"), query))
    return public(out.orderBy(F.col("id").desc()).limit(limit))


def public(facts: DataFrame) -> DataFrame:
    return facts.drop("embedding")


def review_queue(facts: DataFrame, query: str | None = None) -> DataFrame:
    out = facts.where(schema.in_review())
    return (out.where(F.contains(F.lower("content"), F.lit(query.lower()))) if query else out).orderBy(F.col("id").desc())


def trusted(origin: Column, source_app: Column, apps: list[str]) -> Column:
    """The owner always; a tool adapter never; else a registered app."""
    return F.when(origin == "user", True).when(F.coalesce(origin.startswith("mcp:"), F.lit(False)), False).otherwise(F.coalesce(source_app.isin(apps), F.lit(False)))


def gated(rows: DataFrame, apps: list[str], now: float) -> DataFrame:
    """Candidate rows(content, source, origin_agent, source_app, event_date, confidence, importance, conversation_id,
    source_message_id, quarantine_reason) as fact rows without ids; rows of unfit length are left out, see unfit."""
    content = text.normal_spaces(F.coalesce("content", F.lit("")))
    origin = F.coalesce(F.when(F.col("origin_agent") != "", F.col("origin_agent")), F.lit("user"))
    mistrusted = F.col("quarantine_reason").isNull() & ~trusted(origin, F.col("source_app"), apps)
    reason = F.when(mistrusted, F.concat(F.lit("external write ("), origin, F.lit(") — held for review before becoming canon"))).otherwise(F.col("quarantine_reason"))
    return rows.where(F.length(content).between(MIN_FACT, MAX_FACT)).select(
        content.alias("content"), "source", origin.alias("origin_agent"), "conversation_id", "source_message_id", F.lit(float(now)).alias("created_at"),
        F.coalesce(scoring.truthy(F.col("event_date")), F.lit(float(now))).alias("event_date"), F.when(mistrusted, F.lit("low")).otherwise(F.col("confidence")).alias("confidence"),
        "importance", text.content_hash(content).alias("content_hash"), F.when(reason.isNotNull(), F.lit(float(now))).alias("quarantined_at"), reason.alias("quarantine_reason"),
        *(c for c in ("line_no",) if c in rows.columns),
    )


def unfit(rows: DataFrame) -> DataFrame:
    """The candidate rows that gated leaves out, with chars (of the content as it would be kept) and reason."""
    chars = F.length(text.normal_spaces(F.coalesce("content", F.lit(""))))
    reason = F.when(chars < MIN_FACT, f"shorter than {MIN_FACT} characters").when(chars > MAX_FACT, f"longer than {MAX_FACT} characters")
    return rows.withColumns({"chars": chars, "reason": reason}).where("reason is not null")


def numbered(rows: DataFrame, order: list[str], first_id: int) -> DataFrame:
    """rows with ids first_id, first_id + 1, ... in order.

    Rows are dealt to ranges of the order and written; a range's rows are numbered on their own, after
    those of the ranges before it, so no task gets a whole batch.
    """
    dealt = stored(rows.repartitionByRange(*order).withColumn("in_range", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("in_range").agg(F.count("*").alias("in_all"))
    before = F.coalesce(F.sum("in_all").over(Window.orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    nth = F.row_number().over(Window.partitionBy("in_range").orderBy(*order))
    placed = dealt.withColumn("id", nth).join(sizes.select("in_range", before.alias("in_before")), "in_range")
    return placed.withColumn("id", (F.col("id") + F.col("in_before") + (first_id - 1)).cast("long")).drop("in_range", "in_before")


def dedupe_in_conversation(candidates: DataFrame, facts: DataFrame, order: str) -> DataFrame:
    """candidates with existing_id: the lowest id of a fact of equal hash in the conversation that isn't
    superseded; and repeat: a candidate before it in the batch says the same."""
    known = facts.where(F.col("invalidated_at").isNull()).groupBy("conversation_id", "content_hash").agg(F.min("id").alias("existing_id"))
    first = Window.partitionBy("conversation_id", "content_hash").orderBy(order)
    repeat = F.col("conversation_id").isNotNull() & (F.row_number().over(first) > 1)
    return candidates.withColumn("repeat", repeat).join(known, ["conversation_id", "content_hash"], "left")


def patch(facts: DataFrame, patches: DataFrame) -> DataFrame:
    """facts after patches(id, content, event_date, confidence, importance), null for no change; new content loses its vector."""
    p = patches.select("id", text.normal_spaces(F.col("content")).alias("p_content"), *(F.col(c).alias(f"p_{c}") for c in ("event_date", "confidence", "importance")))
    joined = facts.join(p, "id", "left")
    changed = F.col("p_content").isNotNull()
    values = {
        "content": F.coalesce("p_content", "content"), "content_hash": F.when(changed, text.content_hash(F.col("p_content"))).otherwise(F.col("content_hash")),
        "embedding": F.when(~changed, F.col("embedding")), "event_date": F.coalesce("p_event_date", "event_date"), "confidence": F.coalesce("p_confidence", "confidence"),
        "importance": F.when(F.col("p_importance").isNotNull(), scoring.clamp(F.col("p_importance"), 1, 10)).otherwise(F.col("importance")),
    }
    return joined.select(*(values.get(c, F.col(c)).alias(c) for c in facts.columns))


def supersede(facts: DataFrame, pairs: DataFrame, now: float) -> DataFrame:
    """facts after pairs(old_id, new_id, pos); the first of a row's pairs wins, an invalidated row stays as it is."""
    first = pairs.groupBy("old_id").agg(F.min_by("new_id", "pos").alias("new_id"))
    joined = facts.join(first, facts["id"] == first["old_id"], "left")
    hit = F.col("new_id").isNotNull() & F.col("invalidated_at").isNull()
    values = {"invalidated_at": F.when(hit, F.lit(float(now))).otherwise(F.col("invalidated_at")), "superseded_by": F.when(hit, F.col("new_id")).otherwise(F.col("superseded_by"))}
    return joined.select(*(values.get(c, F.col(c)).alias(c) for c in facts.columns))


def _where(facts: DataFrame, hit: Column, **values) -> DataFrame:
    return facts.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def quarantine(facts: DataFrame, ids: list[int], reason: str, now: float) -> DataFrame:
    return _where(facts, F.col("id").isin(ids) & F.col("quarantined_at").isNull(), quarantined_at=F.lit(float(now)), quarantine_reason=F.lit(reason))


def quarantine_report(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(id, pos) once each in input order with outcome quarantined or skipped."""
    once = ids.groupBy("id").agg(F.min("pos").alias("pos"))
    eligible = facts.where(F.col("quarantined_at").isNull()).select("id", F.lit("quarantined").alias("outcome"))
    return once.join(eligible, "id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("skipped")))


def approve(facts: DataFrame, ids: list[int]) -> DataFrame:
    null = F.lit(None)
    return _where(facts, F.col("id").isin(ids), quarantined_at=null, quarantine_reason=null, review_dismissed_at=null)


def dismiss(facts: DataFrame, ids: list[int] | None, now: float) -> DataFrame:
    """ids None: the whole review queue."""
    hit = schema.in_review() if ids is None else F.col("id").isin(ids) & schema.quarantined()
    return _where(facts, hit, review_dismissed_at=F.lit(float(now)))


def hard_delete(facts: DataFrame, ids: list[int]) -> DataFrame:
    return facts.where(~F.col("id").isin(ids))


def fill_importance(facts: DataFrame, scores: DataFrame) -> DataFrame:
    """importance from scores(id, score) where it is null."""
    joined = facts.join(scores.select("id", F.col("score").alias("new_score")), "id", "left")
    return joined.withColumn("importance", F.coalesce("importance", "new_score")).drop("new_score").select(*facts.columns)


def parse_scores(outputs: DataFrame) -> DataFrame:
    """id and score (1 to 9) from outputs(pos, text) of lines "<id>=<score>" or "<id>: <score>"; the last line of an id wins."""
    lines = outputs.select("pos", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    pattern = r"^\s*\[?(\d+)\]?\s*[=:]\s*(\d+)"
    found = lines.select("pos", "line_no", F.regexp_extract("line", pattern, 1).alias("id"), F.regexp_extract("line", pattern, 2).alias("score")).where("id <> ''")
    return found.groupBy(F.col("id").cast("long").alias("id")).agg(scoring.clamp(F.max_by(F.col("score").cast("int"), F.struct("pos", "line_no")), 1, 9).alias("score"))


def provenance_tag(origin: Column, source: Column) -> Column:
    return F.when(origin == "user", F.lit("direct")).when(source == "chat", F.lit("mined")).otherwise(F.coalesce(F.when(origin != "", origin), F.lit("unknown")))


def provenance(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """id, origin_agent, source, tag for ids(id, pos) that exist."""
    return ids.join(facts.select("id", "origin_agent", "source"), "id").withColumn("tag", provenance_tag(F.col("origin_agent"), F.col("source")))


def fact_line() -> Column:
    """One line for a reader: day (? if unsure), origin, content, end of validity."""
    day = F.concat(scoring.day_of(scoring.moment(F.col("event_date"), F.col("created_at"))), F.when(F.col("confidence") == "low", "?").otherwise(""))
    ended = F.when(F.col("invalidated_at").isNotNull(), F.concat(F.lit(" [SUPERSEDED "), scoring.day_of(F.col("invalidated_at")), F.lit(" — historical, no longer current]"))).otherwise("")
    return F.concat(F.lit("["), day, F.lit(" ·"), F.coalesce("origin_agent", F.lit("")), F.lit("] "), F.col("content"), ended)


def admin_line() -> Column:
    return F.concat(F.lit("[id="), F.col("id").cast("string"), F.lit(" · "), schema.status_label(), F.lit(" · event "), scoring.day_of(F.col("event_date")), F.lit(" · origin "), F.coalesce("origin_agent", F.lit("")), F.lit("] "), F.col("content"))


def summary_line() -> Column:
    day = scoring.day_of(F.coalesce(scoring.moment(F.col("event_date"), F.col("created_at")), F.lit(0.0)))
    day = F.when(day == "?", F.lit("1970-01-01")).otherwise(day)
    return F.concat(F.lit("- ["), F.col("id").cast("string"), F.lit(" · "), day, F.lit(" · "), provenance_tag(F.col("origin_agent"), F.col("source")), F.lit("] "), F.col("content"))


def block(rows: DataFrame, line: Column, order: list, empty: str) -> DataFrame:
    """All lines of a bounded list as one text, or a stand-in when there are none."""
    lines = rows.agg(F.array_sort(F.collect_list(F.struct(*(o.alias(f"k{i}") for i, o in enumerate(order)), line.alias("line")))).alias("lines"))
    text_ = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return lines.select(F.when(F.size("lines") > 0, text_).otherwise(F.lit(empty)).alias("block"))


def duplicate_groups(facts: DataFrame) -> DataFrame:
    """id, content_hash, n: the valid facts that say what others say, and how many do; no group is gathered in a row."""
    rows = facts.where(schema.valid()).select("id", "content_hash")
    return rows.join(rows.groupBy("content_hash").agg(F.count("*").alias("n")).where("n > 1"), "content_hash").select("id", "content_hash", "n")


def keepers(facts: DataFrame) -> DataFrame:
    """Of each group of duplicates the row that stays: most important (null: 5), newest, largest id."""
    order = F.struct(F.coalesce("importance", F.lit(scoring.DEFAULT_IMPORTANCE)).alias("imp"), F.col("created_at"), F.col("id"))
    return facts.where(schema.valid()).groupBy("content_hash").agg(F.count("*").alias("n"), F.max(order)["id"].alias("keep_id")).where("n > 1").select("content_hash", "n", "keep_id")


def pin_candidates(facts: DataFrame) -> DataFrame:
    return facts.where(schema.valid() & F.col("importance").between(7, 9)).orderBy("id")


def health(facts: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(c)
    return facts.agg(F.count("*").alias("total"), count(schema.valid()).alias("current"), count(schema.superseded()).alias("superseded"), count(schema.quarantined()).alias("quarantined"), count(schema.in_review()).alias("pending_review"))


def supersede_candidates(facts: DataFrame, recalled: DataFrame, newest: int = 250) -> DataFrame:
    """The newest valid facts and the recalled ones(id), once each; for one mining window."""
    recent = facts.where(schema.valid()).orderBy(F.col("id").desc()).limit(newest).select("id")
    return facts.join(recent.unionByName(recalled.select("id")).distinct(), "id", "left_semi")
