"""Who mines which conversations: leases with a term and a fencing number, and the marks they guard.

Leases and marks share one commit log, so they have one order. A lease is an entry with an end and a table
of the conversations that it holds; its number is its fence. A run asks for conversations and gets those
that no lease holds; a lease that is past its end or given back holds nothing, so a run that died blocks
nobody for longer than its term. Marks are taken from a lease as long as no later lease has its
conversation: what a run writes after another took over is refused for those conversations, whatever its
clock says; a lease that was given back, or ended more than FORGOTTEN_AFTER_S before another was taken,
can't commit any more. Nothing is looped over by conversation on the driver.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log import Log

TERM_S = 3600.0
FORGOTTEN_AFTER_S = 86_400.0
MERGE_AFTER = 16
IDS, MARKS = "id long", "id long, mined_upto long"


def _after(state: dict, entry: dict) -> dict:
    kind = entry["kind"]
    if kind == "lease":
        known = [x for x in state["leases"] if x["until"] > entry["now"] - FORGOTTEN_AFTER_S]
        return state | {"leases": [*known, {k: entry[k] for k in ("fence", "until", "folder")}]}
    if kind == "release":
        return state | {"leases": [x for x in state["leases"] if x["fence"] != entry["fence"]]}
    return state | {"marks": [m for m in state["marks"] if m not in entry["replaces"]] + [entry["folder"]]}


@dataclass
class Lease:
    fence: int
    held: DataFrame
    skipped_locked: int


class Marks:
    """Leases and watermarks of conversations below a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = Log(spark, folder, {"leases": [], "marks": []}, _after)

    def _rows(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def _stage(self, rows: DataFrame, label: str) -> str:
        name = f"staged/{label}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def acquire(self, wanted: DataFrame, now: float, term: float = TERM_S) -> Lease:
        """A lease on the wanted(id) conversations that no lease holds at the time now; skipped_locked counts the others."""
        asked = self._stage(wanted.select("id").distinct(), "asked")
        staged = None

        def decide(number: int, state: dict) -> dict:
            nonlocal staged
            if staged:
                self.log.files.delete(staged)
            others = [x["folder"] for x in state["leases"] if x["until"] > now]
            free = self._rows([asked], IDS)
            staged = self._stage(free.join(self._rows(others, IDS), "id", "left_anti") if others else free, "lease")
            return {"kind": "lease", "fence": number, "now": now, "until": now + term, "folder": staged}

        fence, entry = self.log.append(decide)
        held = self._rows([entry["folder"]], IDS)
        skipped = self._rows([asked], IDS).count() - held.count()
        self.log.files.delete(asked)
        return Lease(fence, held, skipped)

    def advance(self, lease: Lease, marks: DataFrame) -> int:
        """Commits marks(id, mined_upto) of the lease's conversations; how many were refused, as a later lease has theirs."""
        given = self._stage(marks.select("id", "mined_upto").join(lease.held, "id", "left_semi"), "given")
        staged = None

        def decide(_: int, state: dict) -> dict | None:
            nonlocal staged
            if staged:
                self.log.files.delete(staged)
            own = self._rows([given], MARKS)
            later = [x["folder"] for x in state["leases"] if x["fence"] > lease.fence]
            if all(x["fence"] != lease.fence for x in state["leases"]):
                staged = None
                return None  # given back
            fit = own.join(self._rows(later, IDS).distinct(), "id", "left_anti") if later else own
            old = state["marks"] if len(state["marks"]) >= MERGE_AFTER else []
            if old:
                fit = self._rows(old, MARKS).unionByName(fit).groupBy("id").agg(F.max("mined_upto").alias("mined_upto"))
            staged = self._stage(fit, "marks")
            return {"kind": "marks", "fence": lease.fence, "folder": staged, "replaces": old}

        total = self._rows([given], MARKS).count()
        done = self.log.append(decide)
        kept = self._rows([given], MARKS).join(self._rows([done[1]["folder"]], MARKS).select("id", F.col("mined_upto").alias("m")), "id").where("m >= mined_upto").count() if done else 0
        self.log.files.delete(given)
        return total - kept

    def release(self, lease: Lease) -> None:
        """Gives the lease back."""
        self.log.append(lambda _, state: {"kind": "release", "fence": lease.fence} if any(x["fence"] == lease.fence for x in state["leases"]) else None)

    def marks(self) -> DataFrame:
        """id, mined_upto of conversations that were mined."""
        return self._rows(self.log.state()[1]["marks"], MARKS).groupBy("id").agg(F.max("mined_upto").alias("mined_upto"))

    def conversations(self, conversations: DataFrame) -> DataFrame:
        """conversations with mined_upto as far as it was committed."""
        found = self.marks().withColumnRenamed("mined_upto", "new_mark")
        return conversations.join(found, "id", "left").withColumn("mined_upto", F.greatest("mined_upto", "new_mark")).drop("new_mark")
