"""Table schemas and the row states that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = 1

DDL = {
    "facts": "id long, content string, source string, origin_agent string, conversation_id long, source_message_id long, created_at double, event_date double,"
    " confidence string, importance int, content_hash string, embedding array<float>, invalidated_at double, superseded_by long, quarantined_at double,"
    " quarantine_reason string, review_dismissed_at double",
    "conversations": "id long, source_app string, external_id string, title string, mined_upto long, created_at double",
    "messages": "id long, conversation_id long, external_id string, speaker string, content string, created_at double",
    "attachments": "id long, conversation_id long, message_external_id string, filename string, mime string, size long, sha256 string, stored_name string, extracted_text string, created_at double",
    "settings": "key string, value string",
    "summary_versions": "id long, generated_at double, content string, source_fact_ids array<long>, word_count int, word_budget int, model string, restored_from long",
    "access_log": "id long, ts double, kind string, origin string, query string, result_ids array<struct<fact_id:long,score:double>>, result_count int",
    "attachment_captions": "attachment_id long, caption string, model string, created_at double",
}


def valid(prefix: str = "") -> Column:
    """Neither superseded nor quarantined."""
    return F.col(prefix + "invalidated_at").isNull() & F.col(prefix + "quarantined_at").isNull()


def superseded() -> Column:
    return F.col("invalidated_at").isNotNull()


def quarantined() -> Column:
    return F.col("quarantined_at").isNotNull()


def in_review() -> Column:
    """Quarantined and not dismissed."""
    return quarantined() & F.col("review_dismissed_at").isNull()


def decay_population() -> Column:
    """Not superseded; quarantined rows belong to it."""
    return F.col("invalidated_at").isNull()


def status_label() -> Column:
    """superseded, dismissed, pending review or approved, the first that holds."""
    return (
        F.when(superseded(), "superseded")
        .when(quarantined() & F.col("review_dismissed_at").isNotNull(), "dismissed")
        .when(quarantined(), "pending review")
        .otherwise("approved")
    )
