"""Text checks and normal forms as Column expressions.

Letters and digits are spelled out as \\p{L}\\p{N}_ so that they mean the same in every engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the capital-letter pattern catches though they name nobody.
STOPWORDS = [
    "i", "the", "a", "an", "he", "she", "his", "her", "him", "new", "none", "it", "its", "they", "and", "but", "also", "with", "for", "this", "that",
    "ai", "api", "url", "urls", "ui", "ux", "ceo", "cto", "mcp", "llm", "rag", "ide", "sdk", "os", "tv", "id", "ok",
]
# Framing that makes a source fiction, and vocabulary of lines that are dropped.
PERSONA = (
    r"\b(context for the model|candidate context|pretend (you|to be)|role-?play|rehears\w*|persona|you are playing|mock interview|"
    r"what do you (know|remember) about me|tell me about myself|my profile|keep it pg)\b"
)
SYSTEM_META = (
    r"\b(claude code|memory ledger|grounding wall|scope wall|source-trust wall|the extraction walls?|quarantin\w*|supersed\w*|the miner|mined?_upto|"
    r"consolidation (pass|sweep)|synthesis fact|PID \d)\b"
)
BUILDER_PROCESS = (
    r"\b((?:issue|pr|pull request|ticket)\s*#\d+|#\d+\s*(?:issue|pr|pull request|ticket)|pull request|opened (?:a|the) (?:pr|pull request|issue)|"
    r"(?:merged|closed) (?:the |a )?(?:pr|pull request|issue|ticket)|code review|review comment|LGTM|merge conflict|squash(?:ed|ing)?(?: and)? merged?|"
    r"rebas\w*|cherry-pick\w*|CI (?:is |just )?(?:green|red|passing|failing|broke\w*)|(?:green|red) build|flaky test\w*|hotfix\w*|stack trace|null pointer|"
    r"off-by-one|compile error|syntax error|type error|boilerplate code|button color|border-radius|z-index|pixel[- ]perfect|css class|styling pass|"
    r"layout tweak|spacing tweak|ui polish)\b"
)
# How times and dates are written.
RELATIVE_TIME = (
    r"\b(tomorrow|yesterday|tonight|(?:next|last|this)\s+(?:week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)|"
    r"in\s+\d+\s+(?:day|week|month|year)s?|\d+\s+(?:day|week|month|year)s?\s+(?:ago|away|from\s+now|later))\b"
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t)?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"

WORD_CHAR = r"\p{L}\p{N}_"
CAPITALISED = rf"[A-Z][{WORD_CHAR}&.+-]*(?:\s+[A-Z][{WORD_CHAR}&.+-]*)*"
ISO_DATE = r"\b(\d{4})-(\d{2})-(\d{2})\b"
MONTH_DAY = rf"(?i)\b({MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?\b"
DAY_MONTH = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?({MONTH})(?:,?\s+(\d{{4}}))?\b"


def normal_spaces(text: Column) -> Column:
    """White-space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_hash(text: Column) -> Column:
    """16 hex digits of the text's letters and digits in lower case."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(F.lower(text), rf"[^{WORD_CHAR}]+", " ")), 256), 1, 16)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def proper_nouns(text: Column, allowed: list[str]) -> Column:
    """Capitalised phrases but stopwords, allowed words and phrases made only of these."""
    known = F.array(*map(F.lit, STOPWORDS + [a.lower() for a in allowed]))
    bare = F.transform(_matches(text, CAPITALISED), lambda p: F.regexp_replace(F.trim(p), r"^[.,;:!?'\"]+|[.,;:!?'\"]+$", ""))
    # a phrase is kept if it isn't known as a whole and one of its words isn't either
    return F.filter(bare, lambda p: (p != "") & ~F.array_contains(known, F.lower(p)) & F.exists(F.split(F.lower(p), r"\s+"), lambda w: ~F.array_contains(known, w)))


def ungrounded_entities(fact: Column, source: Column, allowed: list[str]) -> Column:
    """Proper nouns of fact that source lacks, whole or by a word of four characters or more."""
    low = F.lower(F.coalesce(source, F.lit("")))
    return F.filter(
        proper_nouns(fact, allowed),
        lambda p: ~F.contains(low, F.lower(p)) & ~F.exists(F.split(F.lower(p), r"[\s\-/.]+"), lambda w: (F.length(w) >= 4) & F.contains(low, w)),
    )


def _date(month: Column, day: Column, year: Column) -> Column:
    return F.struct(month.cast("int").alias("month"), day.cast("int").alias("day"), year.cast("int").alias("year"))


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(F.lower(name), 1, 3))


def explicit_dates(text: Column) -> Column:
    """Distinct (month, day, year or null) of dates written in text; impossible dates are left out."""
    # the text is searched once a pattern; parts are taken from the short matches
    triple = lambda pattern: F.transform(_matches(text, pattern), lambda m: F.struct(*(F.regexp_extract(m, pattern, k).alias(f"g{k}") for k in (1, 2, 3))))
    none_if_empty = lambda x: F.when(x != "", x)
    iso = F.transform(triple(ISO_DATE), lambda g: _date(g["g2"], g["g3"], g["g1"]))
    mdy = F.transform(triple(MONTH_DAY), lambda g: _date(_month(g["g1"]), g["g2"], none_if_empty(g["g3"])))
    dmy = F.transform(triple(DAY_MONTH), lambda g: _date(_month(g["g2"]), g["g1"], none_if_empty(g["g3"])))
    real = lambda d: F.try_to_date(F.format_string("%04d-%02d-%02d", F.coalesce(d["year"], F.lit(2000)), d["month"], d["day"]), "yyyy-MM-dd").isNotNull() & (F.coalesce(d["year"], F.lit(2000)) > 0)
    return F.array_distinct(F.filter(F.concat(iso, mdy, dmy), real))


def relative_phrases(text: Column) -> Column:
    return _matches(text, "(?i)" + RELATIVE_TIME, 1)


def ungrounded_temporal(fact: Column, source: Column) -> Column:
    """MM-DD of dates in fact that source lacks (whatever the year), then relative phrases that source lacks."""
    day = lambda d: F.format_string("%02d-%02d", d["month"], d["day"])
    theirs = F.transform(explicit_dates(source), day)
    dates = F.filter(F.transform(explicit_dates(fact), day), lambda d: ~F.array_contains(theirs, d))
    said = F.transform(relative_phrases(source), lambda p: F.lower(p))
    return F.concat(dates, F.filter(relative_phrases(fact), lambda p: ~F.array_contains(said, F.lower(p))))


def source_trusted(source: Column) -> Column:
    return ~F.coalesce(source, F.lit("")).rlike("(?i)" + PERSONA)


def is_system_meta(fact: Column) -> Column:
    return F.coalesce(fact, F.lit("")).rlike("(?i)" + SYSTEM_META)


def in_scope(fact: Column) -> Column:
    return ~is_system_meta(fact)


def is_builder_process(fact: Column) -> Column:
    return F.coalesce(fact, F.lit("")).rlike("(?i)" + BUILDER_PROCESS)


def check_flags(fact: Column, source: Column, allowed: list[str]) -> Column:
    """Reasons to hold a fact for review, in order: grounding, temporal, source-trust."""
    # an array of one is transformed, so that what it holds is computed once
    said = lambda found, before, after: F.get(F.transform(F.array(found), lambda x: F.when(F.size(x) > 0, F.concat(F.lit(before), F.array_join(x, ", "), F.lit(after)))), 0)
    flags = F.array(
        said(ungrounded_entities(fact, source, allowed), "grounding: ", " not in source chat"),
        said(ungrounded_temporal(fact, source), "temporal: ", " not stated in source chat"),
        F.when(~source_trusted(source), F.lit("source-trust: chat contains roleplay/persona/dossier framing")),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def speaker_class(speaker: Column) -> Column:
    s = F.trim(F.coalesce(speaker, F.lit("")))
    name = F.trim(F.regexp_extract(s, r"(?s)^[^:]*:(.*)$", 1))
    guest = F.lower(F.trim(F.regexp_extract(s, r"^([^:]*):", 1))) == "guest"
    return (
        F.when(s == "user", "owner")
        .when(~F.contains(s, F.lit(":")), F.when(s == "", "unrecognised").otherwise("model"))
        .when(guest & ((name == "") | (F.lower(name) == "unknown")), "guest-unknown")
        .when(guest, "guest")
        .otherwise("unrecognised")
    )


def guest_name(speaker: Column) -> Column:
    return F.when(speaker_class(speaker) == "guest", F.trim(F.regexp_extract(F.trim(speaker), r"(?s)^[^:]*:(.*)$", 1)))


def speaker_flag(speaker: Column) -> Column:
    """Why a turn's facts are held for review; null for the owner and models."""
    c = speaker_class(speaker)
    return (
        F.when(c == "guest", F.concat(F.lit("guest-attribution: stated by guest "), guest_name(speaker), F.lit(", not the owner")))
        .when(c == "guest-unknown", F.lit("guest-attribution: speaker unidentified (diarization could not attribute this turn confidently)"))
        .when(c == "unrecognised", F.concat(F.lit("speaker-trust: unrecognised speaker class '"), F.coalesce(speaker, F.lit("")), F.lit("', treated as untrusted")))
    )


def speaker_label(speaker: Column, owner: str) -> Column:
    c = speaker_class(speaker)
    return (
        F.when(speaker == "user", F.lit(owner))
        .when(c == "guest", F.concat(guest_name(speaker), F.lit(" (guest)")))
        .when(c == "guest-unknown", F.lit("Unidentified speaker (guest)"))
        .otherwise(speaker)
    )


def human_speaker(speaker: Column) -> Column:
    return speaker_class(speaker).isin("owner", "guest", "guest-unknown")


def valid_origin(origin: Column) -> Column:
    return F.coalesce(origin.rlike(r"^[a-z][a-z0-9:_-]{0,31}$"), F.lit(False))
