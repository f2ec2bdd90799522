"""An insert-or-ignore table that streams write exactly once.

A batch's new rows are staged in a folder of their own; an entry of the table's commit log, keyed by query
id and batch number, makes them part of the table. So a batch that is run again changes nothing, whether
its run was killed before or after its entry; another query, or the same source under a new checkpoint,
adds the rows whose keys aren't there yet and replaces nothing. Two writers that commit at once can't both
add a key: the second one's entry is refused, and it takes out what the first one added.

Of the table only the key columns are read, between the batch's smallest and largest first key, and only
keys that the batch has are moved.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import episodes
from .log import Log

STAGED_FOR_S = 86_400


def _after(state: dict, entry: dict) -> dict:
    done = state["done"] | {entry["query"]: max(entry["number"], state["done"].get(entry["query"], -1))}
    return {"folders": state["folders"] + ([entry["folder"]] if entry["folder"] else []), "done": done}


class Table:
    """Rows of schema below a folder, one for each value of keys, the first by order of those that came together."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], order: str) -> None:
        self.spark, self.folder, self.schema, self.keys, self.order = spark, folder.rstrip("/"), schema, keys, order
        self.log = Log(spark, folder, {"folders": [], "done": {}}, _after)

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{f}" for f in folders))

    def read(self) -> DataFrame:
        """The committed rows; what is staged only isn't among them."""
        return self._rows(self.log.state()[1]["folders"])

    def _unknown(self, rows: DataFrame, folders: list[str]) -> DataFrame:
        """rows whose keys aren't in the folders."""
        if not folders:
            return rows
        first = self.keys[0]
        low, high = rows.agg(F.min(first), F.max(first)).first()
        if low is None:
            return rows
        there = self._rows(folders).where(F.col(first).between(low, high)).select(*self.keys)
        met = there.join(rows.select(*self.keys), self.keys, "left_semi")
        return rows.join(met, self.keys, "left_anti")

    def _stage(self, rows: DataFrame, label: str) -> str:
        name = f"staged/{label}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def commit(self, batch: DataFrame, query: str, number: int) -> dict[str, int]:
        """ingested and skipped counts of a batch; a batch that was committed before counts as skipped."""
        total = None
        seen, state = self.log.state()
        staged, known = None, set()
        if number > state["done"].get(query, -1):
            taken = self._stage(batch.select(*self.spark.createDataFrame([], self.schema).columns), "batch")
            rows = self._rows([taken])
            total = rows.count()
            known = set(state["folders"])
            first = episodes.new_rows(rows, self.spark.createDataFrame([], self.schema), self.keys, self.order)
            staged = self._stage(self._unknown(first, state["folders"]), query)
            self.log.files.delete(taken)

        def decide(_: int, now: dict) -> dict | None:
            nonlocal staged, known
            if number <= now["done"].get(query, -1) or staged is None:
                return None
            newer = [f for f in now["folders"] if f not in known]
            if newer:  # others have committed since
                again = self._stage(self._unknown(self._rows([staged]), newer), query)
                self.log.files.delete(staged)
                staged, known = again, known | set(newer)
            return {"query": query, "number": number, "folder": staged}

        done = self.log.append(decide)
        if done is None:
            if staged:
                self.log.files.delete(staged)
            return {"ingested": 0, "skipped": batch.count() if total is None else total}
        added = self._rows([done[1]["folder"]]).count()
        return {"ingested": added, "skipped": total - added}

    def vacuum(self, older_than_s: float = STAGED_FOR_S) -> int:
        """Removes staged folders that no entry names and nobody has written to for a while; how many."""
        used = {f.rpartition("/")[2] for f in self.log.state()[1]["folders"]}
        gone = [n for n in self.log.files.names("staged") if n not in used and self.log.files.age(f"staged/{n}") >= older_than_s]
        for n in gone:
            self.log.files.delete(f"staged/{n}")
        return len(gone)
