"""Streams: exactly-once tables, leases and marks, windows over micro-batches, late attachments."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from recallgrid.operators import episodes, mining
from recallgrid.schema import DDL
from recallgrid.streaming import ingest, leases, log, sink, windows

NOW = 1_700_000_000.0
KEYS = ["conversation_id", "external_id"]


def message(k, conversation=1, text="hello"):
    return (k, conversation, f"m{k}", "user", text, NOW + k)


def messages(spark, *rows):
    return spark.createDataFrame(list(rows), DDL["messages"]).coalesce(1)


def table_of(spark, tmp_path):
    return sink.Table(spark, str(tmp_path / "table"), DDL["messages"], KEYS, "id")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def take(spark, table, source, checkpoint, **more):
    ingest.start(ingest.message_stream(spark, str(source), DDL["messages"]), table, str(checkpoint), **more).awaitTermination()


def test_two_sources_and_two_checkpoints_lose_and_repeat_nothing(spark, tmp_path):
    table = table_of(spark, tmp_path)
    messages(spark, message(1), message(2)).write.parquet(str(tmp_path / "a"))
    messages(spark, message(2, text="again"), message(3)).write.parquet(str(tmp_path / "b"))
    take(spark, table, tmp_path / "a", tmp_path / "check-a")
    take(spark, table, tmp_path / "b", tmp_path / "check-b")
    assert ids(table.read()) == [1, 2, 3]
    take(spark, table, tmp_path / "a", tmp_path / "check-new")  # a renewed checkpoint reads all again
    messages(spark, message(4), message(1)).write.mode("append").parquet(str(tmp_path / "a"))
    take(spark, table, tmp_path / "a", tmp_path / "check-a")
    assert ids(table.read()) == [1, 2, 3, 4]
    assert {r["id"]: r["content"] for r in table.read().collect()}[2] == "hello"


def test_killed_runs(spark, tmp_path, monkeypatch):
    """A run that dies after staging, or after its entry, is run again."""
    table = table_of(spark, tmp_path)
    messages(spark, message(1), message(2)).write.parquet(str(tmp_path / "a"))
    put = log.Files.put
    monkeypatch.setattr(log.Files, "put", lambda *_: (_ for _ in ()).throw(KeyError("killed before its entry")))
    with pytest.raises(Exception, match="killed before"):
        take(spark, table, tmp_path / "a", tmp_path / "check")
    monkeypatch.setattr(log.Files, "put", put)
    assert ids(table.read()) == [] and table.log.files.names("staged")

    def fails(batch, number):
        raise KeyError("killed after its entry")

    with pytest.raises(Exception, match="killed after"):
        take(spark, table, tmp_path / "a", tmp_path / "check", and_then=fails)
    assert ids(table.read()) == [1, 2]
    take(spark, table, tmp_path / "a", tmp_path / "check")
    assert ids(table.read()) == [1, 2]
    assert table.vacuum() == 0 and table.vacuum(0) >= 1
    assert ids(table.read()) == [1, 2]


def test_writers_at_once_add_a_key_once(spark, tmp_path, monkeypatch):
    """The second writer has looked at the table before the first one's entry."""
    table, other = table_of(spark, tmp_path), table_of(spark, tmp_path)
    stage, done = sink.Table._stage, []

    def between(self, rows, label):
        name = stage(self, rows, label)
        if self is table and label == "slow" and not done:
            done.append(other.commit(messages(spark, message(2, text="first"), message(3)), "fast", 0))
        return name

    monkeypatch.setattr(sink.Table, "_stage", between)
    assert table.commit(messages(spark, message(1), message(2, text="second")), "slow", 0) == {"ingested": 1, "skipped": 1}
    assert done == [{"ingested": 2, "skipped": 0}]
    assert {r["id"]: r["content"] for r in table.read().collect()} == {1: "hello", 2: "first", 3: "hello"}


def test_threads_share_one_order(spark, tmp_path):
    where = log.Log(spark, str(tmp_path / "log"), {"n": 0}, lambda s, e: {"n": s["n"] + e["add"]})
    seen = []

    def work():
        for _ in range(8):
            seen.append(where.append(lambda n, s: {"add": 1})[0])

    threads = [threading.Thread(target=work) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(seen) == list(range(1, 33)) and where.state() == (32, {"n": 32})
    assert not [n for n in where.files.names("_log") if n.startswith(".") and not n.endswith(".crc")]


def test_empty_and_odd_batches(spark, tmp_path):
    table = table_of(spark, tmp_path)
    assert table.commit(messages(spark), "q", 0) == {"ingested": 0, "skipped": 0} and table.read().count() == 0
    rows = messages(spark, message(1), message(1, text="repeat"), (9, None, None, "user", None, None)).withColumn("extra", F.lit(1))
    assert table.commit(rows, "q", 1) == {"ingested": 2, "skipped": 1}
    assert table.commit(rows, "q", 1) == {"ingested": 0, "skipped": 3}


def homes(spark, *ids_):
    return spark.createDataFrame([(i, "app", f"c{i}", "", 0, NOW) for i in ids_], DDL["conversations"])


def test_a_second_run_skips_what_is_held(spark, tmp_path):
    marks = leases.Marks(spark, str(tmp_path / "marks"))
    one = marks.acquire(homes(spark, 1, 2), NOW)
    two = marks.acquire(homes(spark, 2, 3), NOW + 1)
    assert (ids(one.held), one.skipped_locked, ids(two.held), two.skipped_locked) == ([1, 2], 0, [3], 1)
    marks.release(one)
    assert ids(marks.acquire(homes(spark, 1, 2, 3), NOW + 2).held) == [1, 2]
    assert ids(marks.acquire(homes(spark, 1, 2, 3), NOW + 2 + leases.TERM_S).held) == [1, 2, 3]  # all terms are over


def test_a_run_that_lost_its_lease_is_fenced(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(leases, "MERGE_AFTER", 3)
    marks = leases.Marks(spark, str(tmp_path / "marks"))
    at = lambda *pairs: spark.createDataFrame(list(pairs), leases.MARKS)
    slow = marks.acquire(homes(spark, 1, 2), NOW, term=10)
    new = marks.acquire(homes(spark, 2), NOW + 11)
    assert marks.advance(new, at((2, 50), (7, 9))) == 0  # 7 isn't its own
    assert marks.advance(slow, at((1, 10), (2, 20))) == 1  # over, but 1 is still free
    assert {r["id"]: r["mined_upto"] for r in marks.marks().collect()} == {1: 10, 2: 50}
    marks.release(slow)
    assert marks.advance(slow, at((1, 99))) == 1
    late = marks.acquire(homes(spark, 1), NOW + 12, term=1)
    marks.acquire(homes(spark, 5), NOW + 20 + leases.FORGOTTEN_AFTER_S)
    assert marks.advance(late, at((1, 99))) == 1
    for k in range(leases.MERGE_AFTER + 3):  # marks are merged now and then
        lease = marks.acquire(homes(spark, 1), NOW + 1e6 + k)
        marks.advance(lease, at((1, 100 + k)))
        marks.release(lease)
    assert {r["id"]: r["mined_upto"] for r in marks.marks().collect()} == {1: 100 + leases.MERGE_AFTER + 2, 2: 50}
    assert len(marks.log.state()[1]["marks"]) < leases.MERGE_AFTER


def test_mining_under_leases(spark, tmp_path):
    files = episodes.attachments_by_message(spark.createDataFrame([], DDL["attachments"]), spark.createDataFrame([], DDL["attachment_captions"]))
    said = messages(spark, *(message(k, 1) for k in (1, 2)), *(message(k, 2) for k in (3, 4)))
    marks, seen = leases.Marks(spark, str(tmp_path / "marks")), []
    run = lambda m, **more: ingest.mine_leased(marks, m, homes(spark, 1, 2), files, "Alex", NOW, **more)

    def during(rows):
        seen.append(run(said))

    def fails(rows):
        raise KeyError("the model is away")

    with pytest.raises(KeyError):
        run(said, and_then=fails)
    assert marks.marks().count() == 0
    assert run(said, and_then=during) == {"held": 2, "skipped_locked": 0, "refused": 0}
    assert seen == [{"held": 0, "skipped_locked": 2, "refused": 0}]
    assert {r["id"]: r["mined_upto"] for r in marks.marks().collect()} == {1: 2, 2: 4}
    counts = []
    run(said.unionByName(messages(spark, message(5, 1))), and_then=lambda rows: counts.append([r["n_messages"] for r in rows.collect()]))
    assert counts == [[1]]


def drain(stream, tmp_path, name):
    out, checkpoint = str(tmp_path / name), str(tmp_path / f"{name}-check")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def test_windows_go_on_over_batches(spark, tmp_path):
    rng = random.Random(0)
    rows = [(rng.randrange(5), i, rng.choice([1, 20, 60, 500])) for i in range(120)]
    schema, source = "conversation_id long, id long, view_len int", str(tmp_path / "in")
    cuts = [0, 1, 40, 41, 90, 120]
    for a, b in zip(cuts, cuts[1:]):
        part = rows[max(0, a - 5) : b]  # the last five come again
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(source)
        got = drain(windows.windows(spark.readStream.schema(schema).parquet(source), 4, 200), tmp_path, "out")
    cols = ["conversation_id", "id", "window_no", "msg_no"]
    placed = got.select(*cols).collect()
    assert sorted(map(tuple, placed)) == sorted(map(tuple, mining.windows(spark.createDataFrame(rows, schema), 4, 200).select(*cols).collect()))
    closed = {(r["conversation_id"], x["window_no"]): x["ids"] for r in got.collect() for x in r["closed"]}
    last = {c: max(r["window_no"] for r in placed if r["conversation_id"] == c) for c in range(5)}
    assert closed == {(c, w): [r["id"] for r in sorted(placed) if (r["conversation_id"], r["window_no"]) == (c, w)] for c in range(5) for w in range(1, last[c])}


def test_windows_of_many_conversations_share_few_keys(spark, tmp_path):
    """Each key of the state is a range of conversations; what they hold of each other's is nothing."""
    rows = [(c - 40, 1000 * turn + c, 20 + c % 50) for turn in range(5) for c in range(200)]
    schema, source, out = "conversation_id long, id long, view_len int", str(tmp_path / "in"), str(tmp_path / "out")
    for k in (0, 2):  # two batches, the second with all that is left
        spark.createDataFrame(rows[200 * k : 400 if k == 0 else None], schema).write.mode("append").parquet(source)
        placed = windows.windows(spark.readStream.schema(schema).parquet(source), 3, 100)
        query = placed.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress) <= 200 / windows.A_KEY + 2
    cols = ["conversation_id", "id", "window_no", "msg_no"]
    got = spark.read.schema(placed.schema).parquet(out).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mining.windows(spark.createDataFrame(rows, schema), 3, 100).select(*cols).collect()))


def test_attachments_bind_before_with_and_after_their_message(spark, tmp_path):
    """In one batch, in batches apart, and long after, when only the table knows the message."""
    files, said = str(tmp_path / "files"), str(tmp_path / "said")
    f = lambda i, m, t: spark.createDataFrame([(i, 1, m, NOW + t)], "id long, conversation_id long, message_external_id string, created_at double").coalesce(1)
    steps = [
        ([f(1, "m1", 0)], []), ([f(2, "m2", 10)], [message(1)]), ([], [message(2)]), ([f(3, "m3", 20)], [message(3)]), ([f(4, "m1", 90_000), f(5, "none", 90_000)], [message(99_999, 2)]),
        ([f(6, "m99999", 200_000)], [message(200_000, 2)]), ([f(7, "x", 300_000)], [message(300_000, 2)]),
    ]
    schemas = (f(0, "", 0).schema, messages(spark).schema)
    for path, schema in zip((files, said), schemas):
        spark.createDataFrame([], schema).write.parquet(path)
    for new_files, new_messages in steps:
        for x in new_files:
            x.write.mode("append").parquet(files)
        if new_messages:
            messages(spark, *new_messages).write.mode("append").parquet(said)
        got = drain(windows.bound(spark.readStream.schema(schemas[0]).parquet(files), spark.readStream.schema(schemas[1]).parquet(said), delay="1 second"), tmp_path, "bound")
    streamed = {r["id"]: r["message_id"] for r in got.collect()}
    assert {k: streamed[k] for k in (1, 2, 3, 4, 5)} == {1: 1, 2: 2, 3: 3, 4: None, 5: None}
    settled = {r["id"]: r["message_id"] for r in windows.settle(got, spark.read.schema(schemas[1]).parquet(said)).collect()}
    assert {k: settled[k] for k in (1, 2, 3, 4, 5)} == {1: 1, 2: 2, 3: 3, 4: 1, 5: None}
