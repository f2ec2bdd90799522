"""Ordered settlement of mined lines: what each line becomes, and what its claims on older facts do.

Lines are settled in order of seq. A line is a repeat where its conversation already has a fact of the
same hash that isn't superseded, an older one or that of a line before it; a repeat claims nothing. Any
other line becomes a fact, held for review where it is quarantined, and its claims on offered facts are
deferred where it is held, refused where the old fact is more than a day newer, and applied else; of
applied claims on one fact the first wins and later ones come too late. So whether a line is a repeat may
hang on a claim of a line before it, whose being a repeat may hang on another. Only texts that both an
older fact and a line say are open in this way: their lines are settled in rounds, each from what the
round before found, until nothing changes. What a line is depends on smaller seqs alone, so there is one
solution, and a chain of n dependent claims takes n + 1 rounds.

Defined results: lines without a conversation or a hash are never repeats; null supersedes claim nothing;
claims on facts that aren't offered are left out; a null quarantined is no quarantine; seq is unique (see
facts.numbered).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from .tables import stored

SECONDS_BACK = 86_400
SALTS = 32
KEY = ["conversation_id", "content_hash"]


def claim_action(held: Column, old_date: Column, new_date: Column) -> Column:
    """defer for a held line, refuse where the old fact is more than a day newer (a date of 0 or null is none), else apply."""
    newer = F.coalesce(scoring.truthy(old_date) - new_date > SECONDS_BACK, F.lit(False))
    return F.when(held, "defer").when(newer, "refuse").otherwise("apply")


def _claims(lines: DataFrame, offered: DataFrame) -> DataFrame:
    wanted = lines.select("seq", "event_date", "quarantined", F.posexplode("supersedes").alias("pos", "old_id"))
    old = offered.select(F.col("id").alias("old_id"), F.col("event_date").alias("old_date"))
    action = claim_action(F.coalesce("quarantined", F.lit(False)), F.col("old_date"), F.col("event_date"))
    return wanted.join(old, "old_id").select("seq", "pos", "old_id", action.alias("action"))


def _opened(blockers: DataFrame, times: DataFrame) -> DataFrame:
    """conversation_id, content_hash, after: the texts whose older facts are all superseded, and the line that did the last."""
    met = blockers.join(times, "old_id", "left").groupBy(*KEY).agg(F.max("at").alias("after"), F.bool_or(F.col("at").isNull()).alias("shut"))
    return met.where("not shut").drop("shut")


def _open_lines(contested: DataFrame, blockers: DataFrame, claims: DataFrame) -> DataFrame:
    """seq of the contested lines that become facts; claims(seq, old_id, sure), sure where the line surely becomes one."""
    added = contested.select("seq").where("false")
    salted = contested.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    n = 0
    while True:
        made = claims.where("sure").select("seq", "old_id").unionByName(claims.where("not sure").join(added, "seq", "left_semi").select("seq", "old_id"))
        opened = _opened(blockers, made.groupBy("old_id").agg(F.min("seq").alias("at"))).select("*", every)
        first = salted.join(opened, [*KEY, "salt"]).where("seq > after").groupBy(*KEY).agg(F.min("seq").alias("seq")).select("seq")
        now = stored(first, "settled")
        m = now.count()
        if m == n and now.join(added, "seq", "left_anti").isEmpty():
            return now
        added, n = now, m


def settle(lines: DataFrame, facts: DataFrame, offered: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What lines(seq, conversation_id, content_hash, quarantined, event_date, supersedes) come to, against facts.

    Gives seq, outcome (added, held, repeat), and seq, pos, old_id, action (apply, late, refuse, defer) of the
    claims of lines that aren't repeats. offered(id, event_date) are the facts that may be superseded, else all
    valid ones.
    """
    lines = stored(lines.select("seq", *KEY, "quarantined", "event_date", "supersedes"), "lines")
    live = facts.where(F.col("invalidated_at").isNull())
    offered = live.where(F.col("quarantined_at").isNull()) if offered is None else offered
    blockers = stored(live.select(*KEY, F.col("id").alias("old_id")).join(lines.select(*KEY).distinct(), KEY, "left_semi"), "blockers")
    blocked = blockers.select(*KEY).distinct()
    contested = stored(lines.join(blocked, KEY, "left_semi").select("seq", *KEY), "contested")
    plain = lines.join(blocked, KEY, "left_anti").select("seq", *KEY)
    keyed = F.col("conversation_id").isNotNull() & F.col("content_hash").isNotNull()
    sure = stored(plain.where(keyed).groupBy(*KEY).agg(F.min("seq").alias("seq")).select("seq").unionByName(plain.where(~keyed).select("seq")), "sure")
    claims = stored(_claims(lines, offered), "claims")
    pressing = claims.where("action = 'apply'").join(blockers.select("old_id"), "old_id", "left_semi").select("seq", "old_id")
    pressing = stored(pressing.join(sure.select("seq", F.lit(True).alias("sure")), "seq", "left").withColumn("sure", F.coalesce("sure", F.lit(False))), "pressing")
    added = sure.unionByName(_open_lines(contested, blockers, pressing))
    outcome = F.when(F.col("new").isNull(), "repeat").when(F.col("quarantined"), "held").otherwise("added")
    found = lines.join(added.select("seq", F.lit(True).alias("new")), "seq", "left").select("seq", outcome.alias("outcome"))
    mine = stored(claims.join(added, "seq", "left_semi"), "claimed")
    first = mine.where("action = 'apply'").groupBy("old_id").agg(F.min(F.struct("seq", "pos")).alias("w")).select("w.seq", "w.pos", F.lit(True).alias("won"))
    action = F.when((F.col("action") == "apply") & F.col("won").isNull(), "late").otherwise(F.col("action"))
    return found, mine.join(first, ["seq", "pos"], "left").select("seq", "pos", "old_id", action.alias("action"))


def counts(found: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: added (held ones too), quarantined, deduped lines; refused and deferred claims."""
    both = found.select(F.col("outcome").alias("what")).unionByName(claims.select(F.col("action").alias("what")))
    n = lambda *values: F.count_if(F.col("what").isin(*values))
    return both.agg(n("added", "held").alias("added"), n("held").alias("quarantined"), n("repeat").alias("deduped"), n("refuse").alias("refused"), n("defer").alias("deferred"))
