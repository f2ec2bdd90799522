"""A commit log: numbered files, each put where none was, so that all writers agree on one order.

A writer reads what is there, decides on its entry, and puts it under the next number. If another came
first, it reads on and decides again. An entry is written aside and renamed in without overwriting, so
readers see whole entries only; the rename is as atomic as the file system's. Every STATE_EVERY-th entry
holds the state of all before it, and readers start from the last of these.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

STATE_EVERY = 20
_putting = threading.Lock()  # local file systems rename after a look; writers of one driver take turns


class Files:
    """The file system of a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.conf, self.folder = spark._jvm, spark._jsc.hadoopConfiguration(), folder.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)
        self._gateway = spark.sparkContext._gateway

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, below: str = "") -> list[str]:
        path = self.path(below)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Puts a file of this text, or gives False if one is there."""
        below, _, last = name.rpartition("/")
        aside = self.path(f"{below}/.{last}-{uuid.uuid4().hex}" if below else f".{last}-{uuid.uuid4().hex}")
        out = self.fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        rename = self._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            with _putting:
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.fs.makeQualified(aside), self.fs.makeQualified(self.path(name)), rename)
            return True
        except Py4JJavaError as e:
            self.fs.delete(aside, False)
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed, by this machine's clock."""
        return (self.jvm.java.lang.System.currentTimeMillis() - self.fs.getFileStatus(self.path(name)).getModificationTime()) / 1000


class Log:
    """Entries below folder/_log. fold(state, entry) gives the state after an entry; states are JSON."""

    def __init__(self, spark: SparkSession, folder: str, start: dict, fold: Callable[[dict, dict], dict]) -> None:
        self.files, self.start, self.fold = Files(spark, folder), start, fold

    def state(self) -> tuple[int, dict]:
        """The last entry's number (0: none) and the state after it."""
        numbers = [int(n[:-5]) for n in self.files.names("_log") if n.endswith(".json") and not n.startswith(".")]
        later: list[dict] = []
        state = None
        for n in reversed(numbers):
            entry = json.loads(self.files.text(f"_log/{n:020d}.json"))
            if "state" in entry:
                state = entry["state"]
                break
            later.append(entry)
        state = json.loads(json.dumps(self.start)) if state is None else state
        for entry in reversed(later):
            state = self.fold(state, entry)
        return (numbers[-1] if numbers else 0), state

    def append(self, decide: Callable[[int, dict], dict | None]) -> tuple[int, dict] | None:
        """Puts the entry that decide(number, state) gives, deciding again while others come first; None if it gives none."""
        while True:
            last, state = self.state()
            entry = decide(last + 1, state)
            if entry is None:
                return None
            whole = entry if (last + 1) % STATE_EVERY else entry | {"state": self.fold(state, entry)}
            if self.files.put(f"_log/{last + 1:020d}.json", json.dumps(whole)):
                return last + 1, entry
