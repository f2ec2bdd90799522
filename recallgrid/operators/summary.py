"""Selection for a summary, its versions and provenance; the language model is an argument."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import text
from . import facts as facts_
from . import recall
from .tables import stored

TOLERANCE = 1.2
PIN_BATCH = 40
WINDOW = 400_000  # characters of a prompt's entries
STRETCH = 1000
NOTES = "Write notes"
NO_SUMMARY = "No memory summary yet."


def section_words(budget: Column) -> Column:
    """Words for a section of a profile of budget words."""
    return F.greatest(F.lit(150), F.floor(budget / 4)).cast("int")


def max_tokens(budget: Column) -> Column:
    return F.greatest(F.lit(8000), budget * 4).cast("int")


def sources(facts: DataFrame, now: float) -> DataFrame:
    """pool, id, line of the two pools in pool order: what a summary is written from."""
    rows = recall.pools(facts, now)
    return rows.select("pool", "id", "event_date", "origin_agent", "source", facts_.summary_line().alias("line"))


def packed(rows: DataFrame, window: int) -> DataFrame:
    """block, text: rows(place, text), places from 0 without gaps, put together in order up to window characters.

    A block has at most window characters beside its last row, or two rows, so that there are at most half
    as many blocks as rows. Characters before a row are summed within stretches of places, then over these.
    """
    stretch = Window.partitionBy("stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    long = rows.select("place", "text", (F.length("text") + 1).alias("chars"), F.floor(F.col("place") / STRETCH).alias("stretch"))
    sums = long.groupBy("stretch").agg(F.sum("chars").alias("all")).select("stretch", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("before"))
    before = F.coalesce(F.sum("chars").over(stretch), F.lit(0)).alias("here")
    block = F.least(F.floor((F.col("here") + F.col("before")) / window), F.floor(F.col("place") / 2))
    placed = long.select("place", "text", "stretch", before).join(sums, "stretch").select("place", "text", block.alias("block"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that few characters still go to many tasks: a block is a call
    parts = placed.repartition(tasks, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("parts"))
    return parts.select("block", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))


def reduced(lines: DataFrame, window: int, ask: Callable[[str], str]) -> str:
    """The texts of lines(day, id, text) in order, if they fit into window characters, else what ask makes of blocks of them, level by level.

    Every line is in the prompt of one block, whole. Each level is written, so a lost task is asked again
    and the others aren't; a call that fails ends the run.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for block, part in zip(f["block"], f["text"], strict=True):
                yield pd.DataFrame({"day": [float(block)], "id": [int(block)], "text": [ask(part) or ""]})

    while True:
        n, chars = lines.agg(F.count("*"), F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()
        if n <= 1 or chars <= window:
            return "\n".join(r["text"] for r in lines.orderBy("day", "id").collect())
        places = facts_.numbered(lines, ["day", "id"], 0).select(F.col("id").alias("place"), "text")
        lines = stored(packed(places, window).mapInPandas(run, "day double, id long, text string").where("text <> ''"), "partial")


def drafted(facts: DataFrame, now: float, budget: int, complete: Callable[[str], str], window: int = WINDOW) -> tuple[str | None, DataFrame]:
    """A profile's text (None without facts), and the facts it was written from: pool, id, event_date, origin_agent, source.

    A pool of more than half of window characters is first made into notes in tasks; then the driver holds
    one prompt. One rewrite if the draft is far over budget; a failed rewrite keeps the draft.
    """
    rows = stored(sources(facts, now), "summary")
    named = rows.drop("line")
    if rows.isEmpty():
        return None, named

    def ask(part: str) -> str:
        return complete(f"{NOTES} of at most {budget} words on these entries; where they differ the later date holds:\n{part}")

    lines = rows.select("pool", F.coalesce("event_date", F.lit(0.0)).alias("day"), "id", F.coalesce("line", F.lit("")).alias("text"))
    block = lambda pool: reduced(lines.where(F.col("pool") == pool).drop("pool"), window // 2, ask) or "(none)"
    draft = complete(f"Write a profile of at most {budget} words, {max(150, budget // 4)} a section.\nLasting:\n{block('durable')}\nCurrent:\n{block('active')}")
    if len(draft.split()) > TOLERANCE * budget:
        try:
            draft = complete(f"Shorten to {budget} words:\n{draft}") or draft
        except Exception:  # noqa: BLE001  the draft is still good
            pass
    return draft, named


def regenerate(facts: DataFrame, now: float, budget: int, complete: Callable[[str], str], window: int = WINDOW) -> dict | None:
    """A version row of a drafted profile, or None without facts. The row names its facts, so their ids (no texts) come to the driver."""
    draft, named = drafted(facts, now, budget, complete, window)
    if draft is None:
        return None
    ids = named.orderBy(F.col("pool").desc(), F.coalesce("event_date", F.lit(0.0)), "id").select("id").collect()
    return {"generated_at": float(now), "content": draft, "source_fact_ids": [r["id"] for r in ids], "word_count": len(draft.split()), "word_budget": budget}


def append_version(versions: DataFrame, row: dict) -> DataFrame:
    """versions with row under the next id."""
    schema = StructType([StructField(f.name, f.dataType, True) for f in versions.schema])
    first = (versions.agg(F.max("id")).first()[0] or 0) + 1
    values = [first if f.name == "id" else row.get(f.name) for f in schema]
    return versions.unionByName(versions.sparkSession.createDataFrame([values], schema))


def restore(versions: DataFrame, version_id: int, now: float) -> DataFrame:
    """versions with a pointer row that holds the old version's content again."""
    old = versions.where(F.col("id") == version_id).first()
    if old is None:
        raise KeyError(version_id)
    return append_version(versions, old.asDict() | {"generated_at": float(now), "restored_from": version_id})


def over_budget(content: Column, budget: Column) -> Column:
    return text.word_count(content) > TOLERANCE * budget


def with_header(content: Column, generated_at: Column) -> Column:
    stamp = F.coalesce(F.date_format(F.timestamp_seconds(generated_at), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("unknown"))
    full = F.concat(F.lit("Profile summary generated_at: "), stamp, F.lit("\nFor time-sensitive or active-thread status, verify with recall.\n\n"), content)
    return F.when(F.coalesce(content, F.lit("")) == "", F.lit(NO_SUMMARY)).otherwise(full)


def pin_nominations(facts: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """id of the pin candidates that the model names, PIN_BATCH candidates a call inside the tasks; a call that fails names none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), PIN_BATCH):
                part = f.iloc[k : k + PIN_BATCH]
                try:
                    said = complete("Which of these should never fade?\n" + "\n".join(f"- [{i}] {c}" for i, c in zip(part["id"], part["content"], strict=True))) or ""
                except Exception:  # noqa: BLE001  nominations are advice
                    said = ""
                yield pd.DataFrame({"id": [i for i in dict.fromkeys(int(x) for x in re.findall(r"\d+", said) if len(x) < 20) if i < 2**63]}, dtype="int64")

    candidates = facts_.pin_candidates(facts).select("id", "content")
    return candidates.select("id").join(candidates.mapInPandas(run, "id long"), "id", "left_semi")


def nominate_pins(facts: DataFrame, complete: Callable[[str], str]) -> list[int]:
    """pin_nominations as a list, by id."""
    return sorted(r["id"] for r in pin_nominations(facts, complete).collect())
