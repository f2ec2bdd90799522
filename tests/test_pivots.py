"""The similarity join against all pairs: few and many vectors, clusters, copies, the cutoff itself."""

from __future__ import annotations

import numpy as np
import pytest

from recallgrid.operators import pivots, recall

CUTOFF = 0.93


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


def tables(spark, a, b):
    return (spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, unit array<double>").repartition(3) for x in (a, b))


def brute(a, b):
    """First id of b that is close, by vector of a."""
    dot = lambda x, y: sum((p * q for p, q in zip(x, y)), 0.0)
    return {tuple(x): met for x in a if x and (met := next((j for j, y in enumerate(b) if y and len(x) == len(y) and dot(x, y) > CUTOFF), None)) is not None}


@pytest.mark.parametrize(("few", "cell"), [(1000, 4096), (0, 4096), (0, 40), (0, 4)])
def test_same_as_all_pairs(spark, monkeypatch, few, cell):
    for name, value in {"FEW": few, "CELL_ROWS": cell, "PIECE_ROWS": 17, "PIECE_OTHERS": 31, "AT_ONCE": 8}.items():
        monkeypatch.setattr(pivots, name, value)
    rng = np.random.default_rng(cell)
    heart = rng.normal(0, 1, (6, 5))
    made = [unit(np.concatenate([heart[rng.integers(6, size=90)] + rng.normal(0, 0.25, (90, 5)), rng.normal(0, 1, (60, 5))])) for _ in "ab"]
    edge = [1.0, 0.0, 0.0, 0.0, 0.0], [0.93, float(np.sqrt(1 - 0.93**2)), 0.0, 0.0, 0.0]
    a = made[0] + [edge[0], None, [1.0, 0.0], *made[0][:20]]
    b = made[1] + [edge[1], None, [0.99, float(np.sqrt(1 - 0.99**2))], [1.0], *made[1][:20], *made[0][:5]]
    rows, others = tables(spark, a, b)
    got = {tuple(r["unit"]): r["met"] for r in pivots.first_close(rows, others, CUTOFF).collect()}
    assert got == brute(a, b)


def test_nothing_to_compare(spark):
    rows, others = tables(spark, [None], [[1.0]])
    assert pivots.first_close(rows, others, CUTOFF).count() == 0 and pivots.first_close(others, rows, CUTOFF).count() == 0


def test_plans_have_no_loop_over_pairs(spark, monkeypatch):
    monkeypatch.setattr(pivots, "FEW", 0)
    rows, others = (x.selectExpr("id", "unit", "'' AS hash") for x in tables(spark, [[1.0, 0.0]] * 3, [[0.0, 1.0]]))
    plan = recall.near(rows, others)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
