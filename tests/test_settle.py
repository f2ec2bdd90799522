"""Ordered settlement against settling line by line."""

from __future__ import annotations

import random

import pytest

from recallgrid.operators import settle
from recallgrid.schema import DDL

DAY = 86_400.0
LINE = "seq long, conversation_id long, content_hash string, quarantined boolean, event_date double, supersedes array<long>"
FACT = "id long, conversation_id long, content_hash string, event_date double, invalidated_at double, quarantined_at double"


def one_by_one(lines, facts):
    """The rule as it reads: each line sees what the lines before it did."""
    rows = {f[0]: list(f) for f in facts}
    offered = {i for i, f in rows.items() if f[4] is None and f[5] is None}
    outcomes, actions, new = {}, {}, set()
    for seq, conv, h, held, date, old_ids in sorted(lines, key=lambda x: x[0]):
        known = conv is not None and h is not None
        if known and ((conv, h) in new or any(f[1] == conv and f[2] == h and f[4] is None for f in rows.values())):
            outcomes[seq] = "repeat"
            continue
        outcomes[seq] = "held" if held else "added"
        new |= {(conv, h)} if known else set()
        for pos, old in enumerate(old_ids or []):
            if old not in offered:
                continue
            if held:
                actions[seq, pos] = "defer"
            elif rows[old][3] and date is not None and rows[old][3] - date > DAY:
                actions[seq, pos] = "refuse"
            else:
                actions[seq, pos] = "late" if rows[old][4] is not None else "apply"
                rows[old][4] = rows[old][4] or 1.0
    return outcomes, actions


def settled(spark, lines, facts):
    found, claims = settle.settle(spark.createDataFrame(lines, LINE), spark.createDataFrame(facts, FACT))
    return {r["seq"]: r["outcome"] for r in found.collect()}, {(r["seq"], r["pos"]): r["action"] for r in claims.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    some = lambda x, share: None if rng.random() < share else x
    facts = [(i, some(rng.randrange(3), 0.1), some(f"h{rng.randrange(8)}", 0.05), some(rng.choice([0.0, DAY, 5 * DAY]), 0.1), some(1.0, 0.8), some(1.0, 0.85)) for i in range(20)]
    lines = [(k, some(rng.randrange(3), 0.1), some(f"h{rng.randrange(12)}", 0.05), some(rng.random() < 0.2, 0.1), some(rng.choice([DAY, 3 * DAY, 9 * DAY]), 0.1), some([rng.randrange(24) for _ in range(rng.randrange(5))], 0.1)) for k in range(60)]
    rng.shuffle(lines)
    assert settled(spark, lines, facts) == one_by_one(lines, facts)


def test_chain_of_claims(spark):
    """Each line is new only because the line before it superseded the fact that says the same."""
    n = 7
    facts = [(i, 1, f"h{i}", DAY, None, None) for i in range(n)]
    lines = [(10 * i, 1, f"h{i}" if i else "start", False, DAY, [i + 1 if i else 0, 1]) for i in range(n)]
    found, claims = settled(spark, lines, facts)
    assert (found, claims) == one_by_one(lines, facts)
    assert set(found.values()) == {"added"}
    assert claims[0, 1] == "apply" and claims[10, 1] == "late"


def test_hot_text(spark):
    lines = [(k, 1, "same", False, DAY, [0]) for k in range(500)]
    found, claims = settled(spark, lines, [(0, 2, "other", DAY, None, None)])
    assert (found[0], sum(x == "repeat" for x in found.values()), claims) == ("added", 499, {(0, 0): "apply"})


def test_empty_tables(spark):
    assert settled(spark, [], []) == ({}, {})
    found, claims = settle.settle(spark.createDataFrame([], LINE), spark.createDataFrame([], DDL["facts"]))
    assert settle.counts(found, claims).first().asDict() == {"added": 0, "quarantined": 0, "deduped": 0, "refused": 0, "deferred": 0}
