"""Mixing sources to target weights by entropy balancing.

Among all rates within [0, cap] that meet a source's token target, those of least relative entropy to
"every document once" are min(cap, exp(multiplier * tilt)), where a document's tilt is its size over the
mean size of its source: rates fall or rise exponentially with length, depending on whether a source has
too many words or too few. Another covariate may be given instead (the constant 1 keeps a source's length
distribution as it is). The multipliers solve a convex dual; Newton steps, safeguarded by bisection, run
for all sources at once as grouped aggregations over the (source, covariate) cells, of which a source has
as many as it has different lengths. Rates become whole copies by carrying the words still owed from document to
document, largest first, within pieces of a source of about PIECE documents, so that a source misses its
target by less than a few of its smallest documents and a hot source is spread over many tasks.

Defined results: null text counts as 0 words; a null source is a source of its own, the last one; a
target above cap times the source's words is met as far as it can be (every document cap times);
sources without words have target 0; equal rows (also in doc_id) are apart only by chance of order
and share one piece; reruns agree to the last digit, as only doc_id, source and text decide
and sums are exact.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import packed, stored

WORD = r"[^\x20\x09-\x0D]+"
PIECE = 4096
NEWTON_ROUNDS, STEPS_A_JOB = 100, 4
TOLERANCE = 1e-9


def cycled_weights(sources: DataFrame, weights: list[float]) -> DataFrame:
    """sources(source, ...) with a weight: the list over and over, by code point of the source, null last.

    The rank is taken over one row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int") + 1).cast("double"))


def capped_targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """sources(source, tokens, weight) with a target: share of all tokens dealt by weight, at most cap * tokens each.

    What a full source cannot take is dealt again by weight until none is above its cap: targets are
    min(cap * tokens, level * weight), and the level rises as sources fill.
    """
    level, full = 0.0, -1
    limit = F.col("tokens") * cap
    while True:
        there = limit <= F.col("weight") * level
        row = sources.agg(
            (F.sum("tokens") * share - F.coalesce(F.sum(F.when(there, limit)), F.lit(0.0))).alias("left"),
            F.coalesce(F.sum(F.when(~there, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count(F.when(there, 1)).alias("full"),
        ).first()
        if not row["weight"] or row["full"] == full:
            break
        level, full = row["left"] / row["weight"], row["full"]
    return sources.withColumn("target", F.least(limit, F.col("weight") * level))


def _exact_sum(x: Column) -> Column:
    """Sum in steps of 2^-40 as decimals: the same in any order, so that partitions and retries don't change a rate's last digits."""
    return F.sum((x * 2.0**40).cast("decimal(38,0)")).cast("double") / 2.0**40


def _newton_step(cells: DataFrame, state: DataFrame, cap: float) -> DataFrame:
    """state after one step; gap is how far its source was from its target before it. One grouped pass over the cells."""
    rate = F.exp(F.least(F.lit(700.0), F.col("multiplier") * F.col("x") * F.col("scale")))
    kept = ["target", "scale", "full", "multiplier", "low", "high"]
    now = cells.join(state, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(
        _exact_sum(F.col("tokens") * F.least(F.lit(float(cap)), rate)).alias("met"),
        _exact_sum(F.when(rate < cap, F.col("tokens") * F.col("x") * F.col("scale") * rate).otherwise(0.0)).alias("slope"),
        *(F.first(c).alias(c) for c in kept),
    )
    gap = F.col("met") - F.col("target")
    now = now.withColumns({"low": F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low")), "high": F.when(gap >= 0, F.col("multiplier")).otherwise(F.col("high"))})
    step = F.col("multiplier") - gap / F.when(F.col("slope") > 0, F.col("slope"))
    middle = F.when(F.col("low") == float("-inf"), F.col("high") - 1 - F.abs("high")).when(F.col("high") == float("inf"), F.col("low") + 1 + F.abs("low")).otherwise((F.col("low") + F.col("high")) / 2)
    off = F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
    done = F.col("full") | (off <= TOLERANCE)
    moved = F.when(done, F.col("multiplier")).when((step > F.col("low")) & (step < F.col("high")), step).otherwise(middle)
    return now.select("s", "target", "scale", "full", moved.alias("multiplier"), "low", "high", F.when(F.col("full"), 0.0).otherwise(off).alias("gap"))


def balanced_rates(cells: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """s, scale, multiplier, full: the dual solution for cells(source, x, tokens) and targets(source, tokens, scale, target).

    A document's rate is min(cap, exp(multiplier * x * scale)). full marks sources whose target is all
    they can give; they need no multiplier. A job does STEPS_A_JOB rounds and stores the state of one row
    a source; the driver sees only the largest relative gap.
    """
    nowhere = {"multiplier": 0.0, "low": float("-inf"), "high": float("inf")}
    state = targets.select(F.col("source").alias("s"), "target", "scale", (F.col("target") >= cap * F.col("tokens") * (1 - 1e-12)).alias("full"), *(F.lit(v).alias(c) for c, v in nowhere.items()))
    before = None
    for _ in range(NEWTON_ROUNDS // STEPS_A_JOB):
        for _ in range(STEPS_A_JOB):
            state = _newton_step(cells, state, cap)
        state = before = stored(state, "duals", replaces=before)
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            break
        state = state.drop("gap")
    return state.select("s", "scale", "multiplier", "full")


def _copies(rows: pd.DataFrame, cap: int) -> pd.DataFrame:
    """Whole copies of each document: what is owed after the documents before it, to the nearest copy."""
    rows = rows.sort_values(["size", "tie"], ascending=[False, True], kind="stable")
    owed, out = 0.0, []
    for size, rate in zip(rows["size"].tolist(), rows["rate"].tolist(), strict=True):
        owed += rate * size
        n = min(cap, max(0, int(owed / size + 0.5))) if size else int(rate + 0.5)
        owed -= n * size
        out.append(min(n, cap))
    return rows.assign(copies=out)[["doc_id", "source", "size", "rate", "copies", "tie"]]


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, cap: int = 2, tilt: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, rate, copies, tie (a hash of the row)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    tie = F.xxhash64("doc_id", "source", "text")
    rows = stored(docs.select("doc_id", "source", size.alias("size"), (size if tilt is None else tilt).cast("double").alias("x"), tie.alias("tie")), "sizes")
    cells = stored(rows.groupBy("source", "x").agg(F.sum("size").cast("double").alias("tokens"), F.count("*").alias("n")), "cells")
    sources = cells.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n"))
    targets = capped_targets(stored(cycled_weights(sources, weights), "sources"), share, cap)
    scale = F.lit(1.0) if tilt is not None else F.when(F.col("tokens") > 0, F.col("n") / F.col("tokens")).otherwise(0.0)  # one over the mean size
    targets = stored(targets.withColumn("scale", scale), "targets")
    duals = balanced_rates(cells, targets, cap)
    plan = targets.drop("scale").join(duals, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("tokens").cast("long").alias("source_size"), "target", "n", "scale", "multiplier", "full")
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "rate", F.when(F.col("source_size") == 0, 0.0).when(F.col("full"), float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.lit(700.0), F.col("multiplier") * F.col("x") * F.col("scale")))))
    )
    piece = F.pmod("tie", F.ceil(F.col("n") / PIECE))
    schema = "doc_id long, source string, size long, rate double, copies int, tie long"
    small = dealt.select("doc_id", "source", "size", "rate", "tie", piece.alias("piece"))
    copies = small.groupBy("source", "piece").applyInPandas(lambda pdf: _copies(pdf, cap), schema)
    return copies.join(plan.select("s", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mixed(docs: DataFrame, weights: list[float], share: float = 1.5, cap: int = 2) -> DataFrame:
    """docs with each row as often as the mix takes it, same columns; of rows equal in doc_id, source and text one stands for all."""
    found = mix(docs, weights, share, cap).groupBy("doc_id", "tie").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    found = stored(found.select(F.col("doc_id").alias("mix_id"), F.col("tie").alias("mix_tie"), F.col("copies").cast("int").alias("copies"), "n"), "copies")
    rows = docs.select("doc_id", F.xxhash64("doc_id", "source", "text").alias("tie"), packed(docs))
    same = rows["doc_id"].eqNullSafe(F.col("mix_id")) & (F.col("tie") == F.col("mix_tie"))
    once = rows.join(found.where("n = 1").hint("shuffle_hash"), same)  # thirty bytes a document are built
    repeated = rows.join(stored(found.where("n > 1"), "repeated"), same).dropDuplicates(["doc_id", "tie"])  # few as a rule: written, so that its size is known
    return once.unionByName(repeated).select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*")
