"""Rules of the memory engine on small tables: state changes, checks, folds, readers, ingest."""

from __future__ import annotations

import base64
import json
import re
import struct

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import scoring, text, vector
from recallgrid.operators import episodes, facts, mining, models, recall, search, summary, viz
from recallgrid.schema import DDL
from recallgrid.sources import readers, snapshots
from recallgrid.streaming import ingest

NOW = 1_700_000_000.0
DAY = 86_400.0


def ledger(spark, rows):
    """Fact rows from dicts; what is left out is null or an everyday value."""
    fields = spark.createDataFrame([], DDL["facts"]).schema
    base = {"source": "user", "origin_agent": "user", "created_at": NOW, "event_date": NOW, "confidence": "high"}
    return spark.createDataFrame([tuple((base | {"id": k + 1, "content": f"fact {k + 1}"} | r).get(f.name) for f in fields) for k, r in enumerate(rows)], fields)


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


@pytest.mark.parametrize(("query", "ids"), [(" #12, 34  56 ", [12, 34, 56]), ("1990", None), ("#abc", None), ("#", None), ("", None), (None, None)])
def test_id_query(query, ids):
    assert facts.parse_id_query(query) == ids


def test_id_query_is_not_cut(spark):
    assert facts.list_facts(ledger(spark, [{}] * 6), query="#1,2,3,4,5", limit=2).count() == 5


def test_limits():
    assert facts.checked_limit("tail", 0) == 0
    with pytest.raises(ValueError, match="recall"):
        facts.checked_limit("recall", 51)


def test_supersede_once(spark):
    pairs = spark.createDataFrame([(1, 2, 0), (1, 3, 1)], "old_id long, new_id long, pos int")
    first = facts.supersede(ledger(spark, [{}, {}, {}]), pairs, NOW)
    again = facts.supersede(first, spark.createDataFrame([(1, 3, 0)], pairs.schema), NOW + 1)
    assert {r["id"]: (r["superseded_by"], r["invalidated_at"]) for r in again.collect()} == {1: (2, NOW), 2: (None, None), 3: (None, None)}


def test_quarantine_many_skips_known_and_unknown(spark):
    ids = spark.createDataFrame([(1, 0), (9, 1), (2, 2), (1, 3)], "id long, pos int")
    out = facts.quarantine_report(ledger(spark, [{"quarantined_at": NOW}, {}]), ids).orderBy("pos").collect()
    assert [(r["id"], r["outcome"]) for r in out] == [(1, "skipped"), (9, "skipped"), (2, "quarantined")]


def test_review_roundtrip(spark):
    held = facts.quarantine(ledger(spark, [{}, {}]), [2], "why", NOW)
    assert [r["id"] for r in facts.review_queue(held).collect()] == [2]
    assert facts.review_queue(facts.dismiss(held, None, NOW)).count() == 0
    assert facts.approve(held, [2]).where("quarantined_at is not null").count() == 0


def test_gate(spark):
    schema = "content string, source string, origin_agent string, source_app string, event_date double, confidence string, importance int, conversation_id long, source_message_id long, quarantine_reason string"
    rows = [("a  long\tenough fact", "user", o, a, 0.0, "high", 5, None, None, None) for o, a in (("user", None), ("mcp:x", "app"), ("app", "app"), ("app", "other"))] + [("short", "user", "user", None, None, None, None, None, None, None)]
    out = facts.gated(spark.createDataFrame(rows, schema), ["app"], NOW).collect()
    assert [(r["content"], r["quarantined_at"] is None, r["confidence"], r["event_date"]) for r in out] == [("a long enough fact", k, "high" if k else "low", NOW) for k in (True, False, True, False)]


def test_unfit_facts_are_named(spark):
    rows = spark.createDataFrame([(1, " a  b "), (2, None), (3, "x" * 10_001), (4, "x" * 10_000), (5, "12345678")], "id long, content string")
    assert sorted(tuple(r) for r in facts.unfit(rows).select("id", "chars", "reason").collect()) == [(1, 3, "shorter than 8 characters"), (2, 0, "shorter than 8 characters"), (3, 10_001, "longer than 10000 characters")]


def test_numbers_follow_the_order_over_all_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("at"), (F.col("id") % 3).alias("kind"), F.lit("x").alias("n"))
    out = facts.numbered(rows, ["kind", "at"], 11)
    assert out.columns == ["at", "kind", "n", "id"]
    assert [r["id"] for r in out.orderBy("kind", "at").collect()] == list(range(11, 5011))
    assert facts.numbered(rows.where("false"), ["at"], 1).count() == 0


def test_dedupe_in_conversation(spark):
    known = ledger(spark, [{"conversation_id": 1, "content_hash": "h"}, {"conversation_id": 2, "content_hash": "g", "invalidated_at": NOW}])
    new = spark.createDataFrame([(10, 1, "h"), (11, 2, "g"), (12, 2, "g"), (13, 3, "h")], "id long, conversation_id long, content_hash string")
    out = {r["id"]: (r["existing_id"], r["repeat"]) for r in facts.dedupe_in_conversation(new, known, "id").collect()}
    assert out == {10: (1, False), 11: (None, False), 12: (None, True), 13: (None, False)}


def test_patch_and_delete(spark):
    p = spark.createDataFrame([(1, " new   content here ", None, None, 99)], "id long, content string, event_date double, confidence string, importance int")
    out = {r["id"]: r for r in facts.patch(ledger(spark, [{"embedding": [1.0]}, {"embedding": [1.0]}]), p).collect()}
    assert (out[1]["content"], out[1]["embedding"], out[1]["importance"]) == ("new content here", None, 10)
    assert out[2]["embedding"] == [1.0]
    assert facts.hard_delete(ledger(spark, [{}, {}]), [1]).count() == 1


def test_scores(spark):
    r = one(spark, pinned=scoring.weight_score(F.lit(10), F.lit(NOW - 3650 * DAY), F.lit(NOW), NOW), old=scoring.weight_score(F.lit(9), F.lit(NOW - 3650 * DAY), F.lit(NOW), NOW), **{f"h{k}": scoring.half_life_days(F.lit(k)) for k in (1, 5, 9)})
    assert r["pinned"] == 1.0
    assert r["old"] < 0.001
    assert (r["h1"], r["h5"], r["h9"]) == (22.5, 52.5, 82.5)


def test_cosine(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    r = one(spark, a=vector.cosine(v(1, 2), v(2, 4)), z=vector.cosine(v(0, 0), v(1, 1)), u=vector.unit(v(0, 0)))
    assert r["a"] == pytest.approx(1)
    assert r["z"] == 0.0
    assert r["u"] is None
    with pytest.raises(Exception, match="different lengths"):
        one(spark, a=vector.cosine(v(1), v(1, 2)))


def test_text_checks(spark):
    r = one(
        spark,
        none=text.proper_nouns(F.lit("The API and SDK and MCP"), []),
        town=text.check_flags(F.lit("Jo moved to Shelbyville"), F.lit("jo is moving"), []),
        known=text.check_flags(F.lit("works at Acme"), F.lit("a job"), ["acme"]),
        june=text.ungrounded_temporal(F.lit("due 2026-06-30"), F.lit("due June 30")),
        soon=text.ungrounded_temporal(F.lit("visits tomorrow"), F.lit("visits")),
        weeks=text.ungrounded_temporal(F.lit("in 3 weeks"), F.lit("it is IN 3 WEEKS")),
        play=text.source_trusted(F.lit("Pretend you are a pirate")),
        meta=text.is_system_meta(F.lit("the fact was quarantined")),
        pr=text.is_builder_process(F.lit("opened a pull request")),
        bad=text.explicit_dates(F.lit("February 30, 2024 and 2024-13-01")),
    )
    assert (r["none"], r["known"], r["june"], r["weeks"], r["bad"]) == ([], [], [], [], [])
    assert r["town"][0].startswith("grounding: ")
    assert r["soon"] == ["tomorrow"]
    assert (r["play"], r["meta"], r["pr"]) == (False, True, True)


@pytest.mark.parametrize(
    ("speaker", "kind", "name"),
    [("user", "owner", None), ("model-a", "model", None), ("system", "model", None), ("guest: Sam ", "guest", "Sam"), ("Guest:Jo", "guest", "Jo"), ("guest:unknown", "guest-unknown", None), ("guest:", "guest-unknown", None), ("agent:x", "unrecognised", None), ("", "unrecognised", None), (None, "unrecognised", None)],
)
def test_speakers(spark, speaker, kind, name):
    s = F.lit(speaker).cast("string")
    r = one(spark, c=text.speaker_class(s), g=text.guest_name(s), f=text.speaker_flag(s))
    assert (r["c"], r["g"]) == (kind, name)
    assert (r["f"] is None) == (kind in ("owner", "model"))


def test_event_dates(spark):
    at = lambda event, source: mining.grounded_event(F.lit(event), F.lit(source), F.lit(1_700_000_060.0))
    r = one(spark, full=at("2023-11-20", "on 2023-11-20"), no_year=at("2023-11-20", "on November 20"), other=at("2023-11-21", "on November 20"), year=at("2022-11-20", "on November 20, 2023"), bad=at("2023-02-30", "on 2023-02-28"))
    assert r["full"] == r["no_year"] == 1_700_438_400.0
    assert (r["other"], r["year"], r["bad"]) == (None, None, None)


def test_windows_and_gate(spark):
    rows = [(1, k, "user" if k < 6 else "model-a", f"m{k}", NOW + k) for k in range(1, 8)]
    m = spark.createDataFrame(rows, "conversation_id long, id long, speaker string, body string, created_at double").withColumn("view_len", F.length("body"))
    w = mining.window_facts(mining.windows(m, 2, 1000), "Alex").orderBy("window_no").collect()
    assert [(r["last_id"], r["mined"]) for r in w] == [(2, True), (4, True), (6, True), (7, False)]
    assert w[0]["transcript"] == "[msg 1] Alex: m1\n\n[msg 2] Alex: m2"


def test_extraction_to_candidates(spark):
    m = spark.createDataFrame([(1, 1, "user", "I moved on June 3", NOW), (1, 2, "guest:Sam", "me too", NOW + 5)], "conversation_id long, id long, speaker string, body string, created_at double").withColumn("view_len", F.length("body"))
    placed = mining.windows(m)
    w = mining.window_facts(placed, "Alex")
    reply = "chatter\n- NEW src=1 importance=12 event=2023-06-03: moved on June 3\nNEW src=2: also moved house\nNONE"
    parsed = mining.parse_lines(mining.extract(w, lambda transcript: reply))
    out = {r["line_no"]: r for r in mining.judge(mining.bind(mining.retry_scores(parsed, lambda fact: 42), placed), w, [], "app").collect()}
    assert (out[1]["importance"], out[1]["quarantine_reason"], out[1]["source_message_id"]) == (9, None, 1)
    assert out[1]["event_date"] == 1_685_750_400.0
    assert out[2]["importance"] == 9
    assert "guest Sam" in out[2]["quarantine_reason"]


def test_supersede_actions(spark):
    new = spark.createDataFrame([(10, NOW, False, [1, 2]), (11, NOW, True, [1])], "id long, event_date double, quarantined boolean, supersedes array<long>")
    old = ledger(spark, [{"event_date": NOW + 2 * DAY}, {"event_date": NOW + DAY / 2}])
    assert {(r["id"], r["old_id"]): r["action"] for r in mining.supersede_actions(new, old).collect()} == {(10, 1): "refuse", (10, 2): "apply", (11, 1): "defer"}


def test_keepers(spark):
    rows = [{"content_hash": "h", "importance": i, "created_at": c} for i, c in ((5, 1.0), (7, 2.0), (None, 9.0))] + [{"content_hash": "g", "created_at": c} for c in (1.0, 2.0)]
    assert {(r["content_hash"], r["keep_id"]) for r in facts.keepers(ledger(spark, rows)).collect()} == {("h", 2), ("g", 5)}


def test_recall_and_trace_agree(spark):
    rows = [{"content": f"the quick brown fox number {k}", "content_hash": f"h{k}", "embedding": [1.0, 0.001 * k, 0.0] if k < 3 else [0.0, float(k % 2), float(k)]} for k in range(8)] + [{"content": "the quick fox", "quarantined_at": NOW, "content_hash": "q"}]
    f = ledger(spark, rows)
    kept = [r["id"] for r in recall.recall(f, "quick fox", [1.0, 0.0, 0.0], NOW, 5).collect()]
    states = {r["id"]: r["state"] for r in recall.trace(f, "quick fox", [1.0, 0.0, 0.0], NOW, 5).collect()}
    assert kept == sorted(kept, key=kept.index)
    assert {k for k, s in states.items() if s == "kept"} == set(kept)
    assert states[2] == states[3] == "collapsed"
    assert 9 not in states
    assert recall.duplicate_edges(f, "quick fox", [1.0, 0.0, 0.0], NOW, 5).where("a <= 3 and b <= 3").count() == 3


def test_dropped_rows_hide_nobody(spark):
    rows = [{"content_hash": "a", "embedding": [1.0, 0.0]}, {"content_hash": "b", "embedding": [0.999, 0.01]}, {"content_hash": "b", "embedding": [0.0, 1.0]}]
    out = recall.states(ledger(spark, rows).withColumn("score", -F.col("id").cast("double")), None).orderBy("pos").collect()
    assert [r["state"] for r in out] == ["kept", "collapsed", "kept"]


def test_pools(spark):
    rows = [{"importance": 6, "content_hash": f"h{k}", "event_date": NOW - k} for k in range(260)] + [{"importance": 10, "content_hash": "pin", "event_date": 1.0}]
    out = {r["pool"]: r["n"] for r in recall.pools(ledger(spark, rows), NOW).groupBy("pool").agg(F.count("*").alias("n")).collect()}
    assert out == {"durable": 201, "active": 60}


def test_many_pinned_facts_collapse_as_in_one_fold(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [{"importance": 10 if k % 3 else 9, "content_hash": f"h{rng.integers(40)}" if k % 4 else "", "embedding": [float(x) for x in rng.normal(0, 1, 3)] if k % 5 else None, "event_date": NOW - k} for k in range(120)]
    order = sorted((k for k, r in enumerate(rows) if r["importance"] == 10)) + [k for k, r in enumerate(rows) if r["importance"] == 9]
    kept, hashes, vectors = set(), set(), []
    for k in order:
        x = rows[k]["embedding"] and np.array(rows[k]["embedding"]) / np.linalg.norm(rows[k]["embedding"])
        if not (rows[k]["content_hash"] in hashes or x is not None and any(v @ x > scoring.PARAPHRASE_CUTOFF for v in vectors)):
            kept.add(k + 1)
            hashes |= {rows[k]["content_hash"]} - {""}
            vectors += [] if x is None else [x]
    f, folded, states = ledger(spark, rows), [], recall.states
    monkeypatch.setattr(recall, "states", lambda rows, *a: folded.append(rows.count()) or states(rows, *a))
    assert {r["id"] for r in recall.pools(f, NOW, 5).where("pool = 'durable'").collect()} == kept
    assert folded[0] <= 5 and max(folded) <= 40  # 80 rows are pinned, 40 are not
    assert {r["id"] for r in recall.pools(f, NOW).where("pool = 'durable'").collect()} == kept


def test_recall_edges_and_strata(spark):
    log = spark.createDataFrame([(1, [1, 2]), (2, [2, 1, 1]), (3, [1, 9])], "id long, result_ids array<long>")
    f = ledger(spark, [{"invalidated_at": None}, {}, {"invalidated_at": NOW, "superseded_by": 1}, {"invalidated_at": NOW, "superseded_by": 3}])
    assert [tuple(r) for r in viz.recall_edges(log, f).collect()] == [(1, 2, 2)]
    assert {tuple(r) for r in viz.strata(f).collect()} == {(1, 3, 1), (1, 4, 2)}


def test_strata_have_no_row_limit(spark):
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, 10)
    try:
        f = ledger(spark, [{}] + [{"invalidated_at": NOW, "superseded_by": k} for k in range(1, 25)])
        assert sorted(tuple(r) for r in viz.strata(f).collect()) == [(1, k + 1, k) for k in range(1, 21)]
    finally:
        spark.conf.set(limit, before)


def test_projection_and_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(0, 0.1, (60, 8)), rng.normal(3, 0.1, (60, 8))])
    f = ledger(spark, [{"embedding": [float(x) for x in p]} for p in points])
    coords = viz.pca3(f.select("id", "embedding"))
    x = {r["id"]: r["x"] for r in coords.collect()}
    assert max(v for k, v in x.items() if k <= 60) < min(v for k, v in x.items() if k > 60) or min(v for k, v in x.items() if k <= 60) > max(v for k, v in x.items() if k > 60)
    sizes = [r["n"] for r in viz.clusters(coords).groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster").collect()]
    assert 6 <= len(sizes) <= 14
    assert sum(sizes) == 120
    assert sizes == sorted(sizes, reverse=True)
    assert viz.pca3(f.select("id", "embedding").limit(2)).where("x <> 0").count() == 0
    assert viz.colours([(0, 1), (1, 2), (0, 2)], 4) == {0: 0, 1: 1, 2: 2, 3: 0}


def test_access_log(spark):
    log = spark.createDataFrame([(k, float(k), "recall", "http", "x" * 2000, [1, 2]) for k in (1, 2, 3)], "id long, ts double, kind string, origin string, query string, result_ids array<long>")
    rows = episodes.access_rows(log)
    assert rows.select(F.max(F.length("query"))).first()[0] == 500
    assert episodes.events_since(rows, 1.0).select(F.max(F.length("query"))).first()[0] == 200
    assert [r["id"] for r in episodes.tail(rows, 2).collect()] == [2, 3]


def test_search(spark):
    home = spark.createDataFrame([(1, "app", "c", "Title", 0, NOW)], DDL["conversations"])
    said = [(1, "the cat sat"), (2, "a dog on the up-hill road"), (3, "hill up and cats")]
    m = spark.createDataFrame([(k, 1, f"m{k}", "user", t, NOW + k) for k, t in said], DDL["messages"])
    a = spark.createDataFrame([(7, 1, "m1", "f.txt", "text/plain", 3, "s", "s.txt", "a cat file", NOW), (8, 1, "m1", "f.png", "image/png", 3, "t", "t.png", "", NOW)], DDL["attachments"])
    c = spark.createDataFrame([(8, "picture of a cat", "m", NOW)], DDL["attachment_captions"])
    found = lambda q: [(r["kind"], r["id"]) for r in search.search(m, home, a, c, q).orderBy("pos").collect()]
    assert found("cat")[0] == ("message", 1)
    assert {x for x in found("cat")[1:]} == {("attachment", 7), ("attachment", 8)}
    assert found("up-hill") == [("message", 2)]
    assert found("") == []
    assert [r["id"] for r in search.search(m, home, a, c, 'cat "').collect()] == [3, 1]
    assert one(spark, s=search.snippet(F.lit("one two cat four"), ["cat"]))["s"] == "one two >>cat<< four"


def test_phrase_counts(spark):
    docs = spark.createDataFrame([(1, "a a a b"), (2, "b, A!"), (3, ""), (4, None), (5, "a")], "id long, t string")
    out = {r["id"]: (r["len"], r["tf"]) for r in search.phrase_counts(docs, "t", [["a"], ["a", "a"], ["b", "a"], ["z"]]).collect()}
    assert out[1] == (4, [3, 2, 0, 0]) and out[2] == (2, [1, 0, 1, 0]) and out[3] == (0, [0, 0, 0, 0]) and out[5] == (1, [1, 0, 0, 0])
    assert sorted(r["id"] for r in search.bm25(docs, "t", [["b"], ["z"]]).collect()) == [1, 2]


def test_models(spark):
    f = ledger(spark, [{"embedding": [1.0]}, {}, {}])
    assert models.fill_embeddings(f, lambda t: [[2.0]] * len(t)).where("embedding is null").count() == 0
    assert models.fill_embeddings(f, lambda t: 1 / 0).where("embedding is null").count() == 2
    scores = facts.parse_scores(models.score_importance(f, lambda lines: "\n".join(f"{x.split(':')[0]}=12" for x in lines.split("\n"))))
    assert {r["importance"] for r in facts.fill_importance(f, scores).collect()} == {9}


def test_summary(spark):
    f = ledger(spark, [{"importance": 8, "content_hash": "a", "content": "likes tea"}])
    said = []
    made = summary.regenerate(f, NOW, 10, lambda p: said.append(p) or ("word " * (30 if len(said) == 1 else 5)))
    assert (made["word_count"], made["source_fact_ids"], len(said)) == (5, [1], 2)
    assert summary.regenerate(f.where("false"), NOW, 10, lambda p: "") is None
    empty = spark.createDataFrame([], DDL["summary_versions"])
    two = summary.restore(summary.append_version(empty, made), 1, NOW + 1)
    assert [(r["id"], r["restored_from"]) for r in two.orderBy("id").collect()] == [(1, None), (2, 1)]
    with pytest.raises(KeyError):
        summary.restore(empty, 5, NOW)
    assert summary.nominate_pins(ledger(spark, [{"importance": 7}, {"importance": 3}]), lambda p: "1, 2 and 77") == [1]


def test_every_pin_candidate_is_offered(spark):
    f = ledger(spark, [{"importance": 7, "content": "x"}] * 1005)
    assert summary.nominate_pins(f, lambda p: ", ".join(re.findall(r"\[(\d+)\]", p))) == list(range(1, 1006))


def test_a_failed_call_names_no_pins(spark):
    def complete(prompt):
        if "[1]" in prompt:
            raise OSError
        return "2, 50, 77"

    assert summary.nominate_pins(ledger(spark, [{"importance": 7}] * 60), complete) == [2, 50]


def test_export(spark, tmp_path):
    block = lambda kind, **x: {"type": kind} | x
    art = block("tool_use", name="artifacts", input={"id": "notes", "title": "Plan", "content": "one\n", "old_str": "was"})
    said = {"uuid": "m1", "sender": "human", "created_at": "2024-01-02T03:04:05Z", "text": "", "content": [block("text", text=" hi\n"), block("thinking", thinking="hm"), block("tool_use", name="", input={"path": " ", "query": "a  b"}), art, block("tool_result")], "attachments": [{"file_name": "", "extracted_content": "x "}, {"file_name": "e.txt", "extracted_content": " "}], "files": [{"file_name": "b.png"}, {"file_name": ""}]}
    empty = {"uuid": "m2", "sender": "assistant", "created_at": "", "text": " ", "content": [], "attachments": [], "files": []}
    plain = empty | {"uuid": "m3", "text": "yes"}
    (tmp_path / "projects").mkdir()
    (tmp_path / "conversations.json").write_text(json.dumps([{"uuid": "c1", "name": "n", "created_at": "2024-01-02", "chat_messages": [said, empty, plain]}, {"uuid": "c2", "name": "e", "created_at": "2024-01-02", "chat_messages": []}]))
    (tmp_path / "projects/p.json").write_text(json.dumps([{"uuid": "p", "name": "P", "description": "D", "prompt_template": "T", "created_at": "2024-01-02", "docs": [{"uuid": "d", "filename": "f", "content": " text "}, {"uuid": "d2", "filename": "", "content": " "}]}, {"uuid": "q", "name": "", "docs": []}]))
    (tmp_path / "memories.json").write_text(json.dumps([{"a": " remember", "b": " ", "n": 5}, {"a": "this\n", "c": None}]))
    read = readers.read_export(spark, str(tmp_path))
    out = readers.export_messages(read["conversations"], NOW)
    rows = out.orderBy("pos").collect()
    assert rows[0]["content"] == "hi\n\n[thinking]\nhm\n\n[tool: tool]\n\n[tool: artifacts Plan]\n\n[file: b.png]\n\n[attachment: attachment]\n\n[attachment: e.txt]"
    assert [tuple(f) for f in rows[0]["attachments"]] == [("notes.txt", "text/plain", "# Plan\n\none\n\n\n[update]\n--- old\nwas\n--- new"), ("attachment", "text/plain", "x")]
    assert [(r["speaker"], r["created_at"]) for r in rows] == [("user", 1_704_164_645.0), ("claude", 1_704_153_600.0)]
    assert tuple(readers.import_counts(read["conversations"], out).first()) == (1, 1, 2, 1, 2)
    made = readers.project_messages(read["projects"], NOW).orderBy("conversation", "pos").collect()
    assert [(r["name"], r["external_id"], r["content"], [tuple(f) for f in r["attachments"]]) for r in made] == [
        ("Project: P", "project-p", "[project] P\n\nD\n\n[prompt template]\nT", []), ("Project: P", "d", "[project doc: f]", [("f", "text/plain", "text")]), ("Project: P", "d2", "[project doc: ]", []),
        ("Project: ", "project-q", "[project]", []),
    ]
    assert [r["created_at"] for r in made] == [1_704_153_600.0] * 3 + [NOW] and {r["speaker"] for r in made} == {"user"}
    assert sorted((r["external_id"], r["content"]) for r in readers.memory_messages(read["memories"]).collect()) == [("memory-0", "remember"), ("memory-1", "this")]


def test_requests(spark, tmp_path):
    file = {"filename": "a.md", "mime": "x/y", "data_b64": base64.b64encode(b"text").decode()}
    request = {"source_app": "app", "conversation_id": "c", "title": "", "messages": [{"external_id": "m1", "speaker": "user", "content": "hi", "created_at": "2024-01-01T00:00:00Z", "attachments": [file, file | {"data_b64": "***"}]}]}
    (tmp_path / "r.json").write_text(json.dumps(request))
    said = readers.request_messages(readers.read_requests(spark, str(tmp_path / "r.json")))
    assert said.first()["created_at"] == 1_704_067_200.0
    assert [(r["extracted_text"], r["size"], r["stored_name"][-3:]) for r in readers.request_files(said).collect()] == [("text", 4, ".md")]


def test_too_large_requests_are_refused(spark):
    message = "struct('e' as external_id, 'user' as speaker, 'c' as content, '2024-01-01T00:00:00Z' as created_at, cast(null as array<struct<filename:string,mime:string,data_b64:string>>) as attachments)"
    request = spark.range(1).selectExpr("'a' as source_app", "'c' as conversation_id", "'' as title", f"array_repeat({message}, {readers.MAX_MESSAGES + 1}) as messages")
    with pytest.raises(Exception, match="too many messages"):
        readers.request_messages(request).collect()
    files = lambda file, n: spark.range(1).selectExpr("'a' as source_app", "'c' as conversation_external_id", "'e' as external_id", f"array_repeat(struct('f.txt' as filename, 'text/plain' as mime, {file} as data_b64), {n}) as attachments")
    with pytest.raises(Exception, match="too many files"):
        readers.request_files(files("'dGV4dA=='", readers.MAX_FILES + 1)).collect()
    with pytest.raises(Exception, match="file too long"):
        readers.request_files(files(f"repeat('A', {readers.MAX_FILE_CHARS + 4})", 1)).select("size").collect()
    assert readers.request_files(files("'dGV4dA=='", readers.MAX_FILES)).count() == readers.MAX_FILES


def test_long_conversations_are_split_into_requests(spark):
    from recallgrid.plans import scans

    n = 2 * readers.MAX_MESSAGES + 7
    messages = spark.range(n).selectExpr("3 * id + 100 as id", "1L as conversation_id", "concat('m', id) as external_id", "'user' as speaker", "'c' as content", "1.7e9D + id as created_at")
    homes = spark.createDataFrame([(1, "a", "c", "")], "id long, source_app string, external_id string, title string")
    requests = scans._requests({"v_messages": messages, "v_conversations": homes}.__getitem__)
    assert sorted(r[0] for r in requests.select(F.size("messages")).collect()) == [7, readers.MAX_MESSAGES, readers.MAX_MESSAGES]
    assert sorted((r["pos"], r["external_id"]) for r in readers.request_messages(requests).collect()) == [(k, f"m{k}") for k in range(n)]


def test_only_what_a_message_shows_of_its_files_is_grouped(spark):
    lengths = [7000, 0, 12_990, 9, 1, 30_000, 5]
    rows = [{"id": 9_996 + k, "conversation_id": 1, "message_external_id": "m", "filename": f"f{k}", "extracted_text": "abcdefghij"[k] * n} for k, n in enumerate(lengths)]
    fields = spark.createDataFrame([], DDL["attachments"]).schema
    table = spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)
    none = spark.createDataFrame([], DDL["attachment_captions"])
    files = episodes.attachments_by_message(table, none)
    assert [(f["filename"], len(f["body"])) for f in files.first()["files"]] == [("f0", 7000), ("f2", 12_990), ("f3", 9), ("f4", 1)]
    message = spark.createDataFrame([(1, 1, "m", "hello")], "id long, conversation_id long, external_id string, content string")
    whole = "hello" + "".join(f"\n[Attached file: {r['filename']}]\n{r['extracted_text']}" for r in rows if r["extracted_text"])
    out = episodes.with_bodies(message, files).first()
    assert (out["body"], out["view_len"]) == (whole[: episodes.MESSAGE_CHARS] + episodes.CUT, episodes.MESSAGE_CHARS)
    assert [len(f["body"]) for f in episodes.attachments_by_message(table.where("id = 10001"), none).first()["files"]] == [episodes.MESSAGE_CHARS + 1]


def test_settings(tmp_path):
    (tmp_path / "config.json").write_text(json.dumps({"user_name": "Jo", "word_budget": 5, "unknown": 1}))
    (tmp_path / "config.local.json").write_text(json.dumps({"word_budget": 6}))
    s = readers.Settings.load(str(tmp_path), {"MEMORY_BACKUP_KEEP": "3", "MEMORY_TRUSTED_APPS": "a,b"})
    assert (s.user_name, s.word_budget, s.backup_keep, s.trusted_apps) == ("Jo", 6, 3, ["a", "b"])


def test_tables_and_snapshots(spark, tmp_path):
    tables, target = str(tmp_path / "tables"), str(tmp_path / "backups")
    readers.create_tables(spark, tables)
    readers.create_tables(spark, tables)
    for k in range(3):
        path = snapshots.backup(spark, tables, target, f"2024010{k}-000000", keep=2)
    assert len(snapshots._list(spark, target)) == 2
    assert not snapshots.changed_since(spark, tables, path)
    spark.createDataFrame([("k", "v")], DDL["settings"]).write.mode("append").parquet(f"{tables}/settings")
    assert snapshots.changed_since(spark, tables, path)
    spark.createDataFrame([(99,)], "version int").write.mode("overwrite").parquet(f"{tables}/_schema")
    with pytest.raises(ValueError, match="version 99"):
        readers.create_tables(spark, tables)


def test_mining_advances(spark):
    home = spark.createDataFrame([(1, "app", "c", "", 1, NOW), (2, "app", "d", "", 0, NOW)], DDL["conversations"])
    m = spark.createDataFrame([(k, 1, f"m{k}", "user", "hello", NOW) for k in (1, 2, 3)], DDL["messages"])
    files = episodes.attachments_by_message(spark.createDataFrame([], DDL["attachments"]), spark.createDataFrame([], DDL["attachment_captions"]))
    windows, moved = ingest.mine(m, home, files, "Alex")
    assert windows.first()["n_messages"] == 2
    assert {r["id"]: r["mined_upto"] for r in moved.collect()} == {1: 3, 2: 0}
    assert ingest.mine(m, moved, files, "Alex")[0].count() == 0


def test_packed_vectors(spark):
    rows = [(1, [0.5, -2.25, 3.0]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "id int, v array<float>").select("id", vector.pack(F.col("v")).alias("b"))
    assert [tuple(r) for r in df.select("id", vector.unpack(F.col("b"))).orderBy("id").collect()] == rows
    assert [bytes(r[0]) if r[0] is not None else None for r in df.orderBy("id").select("b").collect()] == [struct.pack("<3f", 0.5, -2.25, 3.0), b"", None]
    assert spark.createDataFrame([(bytearray(b"abcde"),)], "b binary").select(vector.unpack(F.col("b"))).first()[0] is None
