"""Hybrid recall: similarity, keywords and bounded recency, then greedy near-duplicate collapse.

Scoring is a projection of a scan, whose few columns are written once; texts are read again for survivors only. The collapse is sequential by nature (a dropped row hides nobody), so
it folds over a ranked prefix in one row. The prefix is doubled until it gives `limit` survivors or
holds every candidate; what is folded stays bounded by the prefix, not by the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scoring, vector
from . import pivots
from .tables import stored

RECALL_FIELDS = ["id", "content", "event_date", "confidence", "origin_agent", "score"]
PREFIX = 4
KEPT = "struct<hashes:array<string>,vectors:array<array<double>>,n:int,out:array<struct<id:bigint,score:double,state:string>>>"


def similarity(query_vector: list[float] | None) -> Column:
    if query_vector is None:
        return F.lit(0.0)
    theirs = F.array(*(F.lit(float(x)) for x in query_vector))
    return F.when(F.col("embedding").isNotNull(), vector.cosine(F.col("embedding"), theirs)).otherwise(F.lit(0.0))


def scored(facts: DataFrame, query: str, query_vector: list[float] | None, now: float) -> DataFrame:
    """facts with sem, kw, rec, score and cand (similar enough or with a keyword)."""
    out = facts.withColumns({"sem": similarity(query_vector), "kw": scoring.keyword_hits(F.col("content"), scoring.query_words(query)), "rec": scoring.recency(F.col("event_date"), F.col("created_at"), now)})
    out = out.withColumn("score", scoring.recall_score(F.col("sem"), F.col("kw"), F.col("invalidated_at").isNull(), F.col("rec")))
    return out.withColumn("cand", (F.col("sem") > scoring.SEMANTIC_FLOOR) | (F.col("kw") > 0))


def collapse_fold(ranked: Column, limit: int | None, seed: Column | None = None) -> Column:
    """array<struct<id, score, state>> of an array of struct<id, score, hash, unit> in rank order; unit is the vector at length 1.

    state: kept, dup (hash of a kept row), collapsed (too similar to a kept row) or over (limit reached).
    """
    begin = seed if seed is not None else F.expr(f"cast(named_struct('hashes', array(), 'vectors', array(), 'n', 0, 'out', array()) as {KEPT})")

    def step(s: Column, x: Column) -> Column:
        close = F.coalesce(F.exists(s["vectors"], lambda v: vector.dot(v, x["unit"]) > scoring.PARAPHRASE_CUTOFF), F.lit(False))
        state = F.when(x["unit"].isNotNull() & close, "collapsed").otherwise("kept")
        state = F.when((x["hash"] != "") & F.array_contains(s["hashes"], x["hash"]), "dup").otherwise(state)
        state = F.when(s["n"] >= limit, "over").otherwise(state) if limit is not None else state
        return F.get(F.transform(F.array(state), lambda found: _put(s, x, found)), 0)  # state is computed once

    return F.aggregate(ranked, begin, step, lambda s: s["out"])


def _put(s: Column, x: Column, state: Column) -> Column:
    kept = state == "kept"
    nothing = F.array()
    return F.struct(
        F.concat(s["hashes"], F.when(kept & (x["hash"] != ""), F.array(x["hash"])).otherwise(nothing.cast("array<string>"))).alias("hashes"),
        F.concat(s["vectors"], F.when(kept & x["unit"].isNotNull(), F.array(x["unit"])).otherwise(nothing.cast("array<array<double>>"))).alias("vectors"),
        (s["n"] + kept.cast("int")).alias("n"),
        F.concat(s["out"], F.array(F.struct(x["id"].alias("id"), x["score"].alias("score"), state.alias("state")))).alias("out"),
    )


def ranked_array(rows: DataFrame, *first: Column) -> DataFrame:
    """One row: the rows in order of first (ascending), then id, as an array for the fold. For bounded inputs."""
    order = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(first)), F.col("id").alias("k_id"), F.struct(F.col("id"), F.col("score"), F.coalesce("content_hash", F.lit("")).alias("hash"), vector.unit(F.col("embedding")).alias("unit")).alias("row"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["row"]).alias("ranked"))


def states(rows: DataFrame, limit: int | None, *first: Column) -> DataFrame:
    """id, score, state of bounded rows in rank order, with pos."""
    out = ranked_array(rows, *(first or (-F.col("score"),)))
    return out.select(F.posexplode(collapse_fold(F.col("ranked"), limit)).alias("pos", "x")).select("pos", "x.*")


def readable(facts: DataFrame, include_superseded: bool) -> DataFrame:
    """What recall may show: nothing quarantined, and superseded facts only on demand."""
    there = facts.where(F.col("quarantined_at").isNull())
    return there if include_superseded else there.where(F.col("invalidated_at").isNull())


def collapsed_prefix(found: DataFrame, limit: int) -> DataFrame:
    """pos, id, score, state of the best rows of found, as many as give `limit` survivors (or all).

    A prefix is folded once and written; what is joined later is that small table. Each prefix is read from
    found again, so found is best a stored table.
    """
    prefix = limit * PREFIX
    while True:
        got = stored(states(found.orderBy(F.col("score").desc(), "id").limit(prefix), limit), "fold")
        n, seen = got.agg(F.count_if(F.col("state") == "kept"), F.count("*")).first()
        if n >= limit or seen < prefix:
            return got
        prefix *= 4


def recall(facts: DataFrame, query: str, query_vector: list[float] | None, now: float, limit: int = 10, include_superseded: bool = False) -> DataFrame:
    """The first `limit` survivors by score with the recall fields, score rounded to 4; without a query the newest ids."""
    if not query.strip():
        return readable(facts, True).orderBy(F.col("id").desc()).limit(limit)
    found = scored(readable(facts, include_superseded), query, query_vector, now).where("cand").select("id", "score", "content_hash", "embedding")
    kept = collapsed_prefix(stored(found, "candidates"), limit).where("state = 'kept'")
    ids = [r["id"] for r in kept.select("id").collect()]  # at most limit; as values they reach the scan of the texts
    return kept.select("pos", "id", F.round("score", 4).alias("score")).join(facts.drop("score").where(F.col("id").isin(ids)), "id").orderBy("pos")


def trace(facts: DataFrame, query: str, query_vector: list[float] | None, now: float, limit: int) -> DataFrame:
    """Score parts and state (dim, over, dup, collapsed, kept) of every valid fact.

    Candidates ranked after the last kept one are over; the fold runs on a prefix as in recall.
    """
    imp = F.coalesce(scoring.truthy(F.col("importance")), F.lit(scoring.DEFAULT_IMPORTANCE)).alias("importance")
    nodes = stored(scored(facts.where(schema.valid()), query, query_vector, now).select("id", "cand", imp, "sem", "kw", "rec", "score", "content_hash", "embedding"), "nodes")
    got = collapsed_prefix(nodes.where("cand").select("id", "score", "content_hash", "embedding"), limit)
    rounded = nodes.select("id", "cand", F.col("importance").alias("imp"), F.round("sem", 4).alias("sem"), F.least("kw", F.lit(3)).alias("kw"), F.round("rec", 3).alias("rec"), F.round("score", 4).alias("score"))
    return rounded.join(got.select("id", "state"), "id", "left").withColumn("state", F.coalesce("state", F.when(F.col("cand"), "over").otherwise("dim"))).drop("cand")


def duplicate_edges(facts: DataFrame, query: str, query_vector: list[float] | None, now: float, limit: int, most: int = 200) -> DataFrame:
    """Pairs a, b of close candidates, a ranked before b by the timeless part of the score.

    Candidates that recency cannot lift to the first `limit` are left out, and at most `most` are compared.
    """
    kept = stored(pruned(facts, query, query_vector, now, limit, most), "pruned")
    other = kept.select(F.col("pos").alias("pos_b"), F.col("id").alias("b"), F.col("unit").alias("unit_b"))
    return kept.join(other, (F.col("pos") < F.col("pos_b")) & (vector.dot(F.col("unit"), F.col("unit_b")) > scoring.PARAPHRASE_CUTOFF)).select(F.col("id").alias("a"), "b")


def pruned(facts: DataFrame, query: str, query_vector: list[float] | None, now: float, limit: int, most: int = 200) -> DataFrame:
    """pos, id, unit of the first `most` valid candidates by the timeless part of the score that recency can still lift to the first `limit`."""
    nodes = scored(facts.where(schema.valid()), query, query_vector, now).where("cand")
    nodes = nodes.select("id", "embedding", (F.col("sem") + scoring.KEYWORD_WEIGHT * F.least("kw", F.lit(3)) + scoring.VALID_BONUS).alias("static"))
    top = nodes.orderBy(F.col("static").desc(), "id").limit(most)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("static")).alias("k"), "id", "embedding"))).alias("r"))
    floor = F.when(F.size("r") > limit, -F.get("r", F.lit(limit - 1))["k"] - scoring.RECENCY_WEIGHT).otherwise(F.lit(float("-inf")))
    kept = ranked.select("r", floor.alias("floor")).select("floor", F.posexplode("r").alias("pos", "x"))
    return kept.where((-F.col("x.k") >= F.col("floor")) & F.col("x.embedding").isNotNull()).select("pos", F.col("x.id").alias("id"), vector.unit(F.col("x.embedding")).alias("unit"))


# Fixed values of the two pools, and what one task folds.
DURABLE_KEEP, DURABLE_LOOK, ACTIVE_KEEP, ACTIVE_LOOK = 200, 250, 300, 375
FOLD_ROWS = 1000


def near(rows: DataFrame, others: DataFrame, earlier: bool = False) -> DataFrame:
    """id of the rows that a fold drops if it has kept all others; with earlier, those of smaller id only.

    Equal hashes are compared by their smallest id, so a hash with many rows makes no pairs; vectors meet
    through pivots, or where they are few by going to the others.
    """
    firsts = others.where("hash <> ''").groupBy(F.col("hash").alias("o_hash")).agg(F.min("id").alias("o_id"))
    before = lambda first: F.col(first) < F.col("id") if earlier else F.lit(True)
    same = rows.join(firsts, (F.col("hash") == F.col("o_hash")) & before("o_id")).select("id")
    close = rows.join(pivots.first_close(rows, others, scoring.PARAPHRASE_CUTOFF), "unit").where(before("met")).select("id")
    return same.unionByName(close).distinct()


def hashed(rows: DataFrame) -> DataFrame:
    """id, score, content_hash, embedding with hash and unit as the fold compares them."""
    return rows.select("id", "score", "content_hash", "embedding", F.coalesce("content_hash", F.lit("")).alias("hash"), vector.unit(F.col("embedding")).alias("unit"))


def kept_by_id(rows: DataFrame, most: int = FOLD_ROWS) -> tuple[DataFrame, int, int]:
    """What a fold of rows in order of id keeps, how many these are, and how many rows there were.

    Rounds over all rows at once: a row with no like row before it is kept, whatever is like a kept row is
    dropped, the rest waits. When at most `most` wait, one task folds them.
    """
    left = stored(hashed(rows), "left")
    total = n = left.count()
    kept: list[DataFrame] = []
    while n > most:
        waits = stored(near(left, left, earlier=True), "waits")
        kept.append(stored(left.join(waits, "id", "left_anti"), "kept"))
        waiting = left.join(waits, "id", "left_semi")
        left = stored(waiting.join(near(waiting, kept[-1]), "id", "left_anti"), "left")
        n = left.count()
    kept.append(stored(left.join(states(left, None, F.lit(0)).where("state = 'kept'").select("id"), "id", "left_semi"), "kept"))
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    return found, found.count(), total


def pools(facts: DataFrame, now: float, most: int = FOLD_ROWS) -> DataFrame:
    """pool (durable, active), id, content, event_date, ... of the two disjoint pools of valid facts.

    Durable: pinned facts by id, then the most important and latest. Active: the best of the others by
    weight_score. Pinned facts are any number, so they collapse in rounds; the folds of the others run on
    bounded prefixes, without the rows that are like a row kept before them. What was named is written, so that
    the planner knows its size and doesn't move all texts to meet few ids.
    """
    valid = facts.where(schema.valid())
    weighed = {"imp": F.coalesce(scoring.truthy(F.col("importance")), F.lit(scoring.DEFAULT_IMPORTANCE)), "score": scoring.weight_score(F.col("importance"), F.col("event_date"), F.col("created_at"), now)}
    rows = stored(valid.withColumns(weighed).select("id", "imp", "score", "event_date", "content_hash", "embedding"), "valid")
    pinned, n_kept, n_pinned = kept_by_id(rows.where(F.col("imp") >= scoring.PINNED_FROM), most)
    others = rows.where(F.col("imp") < scoring.PINNED_FROM).orderBy(F.col("imp").desc(), F.coalesce("event_date", F.lit(0.0)).desc(), "id").limit(DURABLE_LOOK)
    others = others.select("id", F.struct((-F.col("imp").cast("double")).alias("a"), (-F.coalesce("event_date", F.lit(0.0))).alias("b")).alias("k"), "score", "content_hash", "embedding")
    lasting = _collapsed(others, pinned, DURABLE_KEEP + n_pinned - n_kept, "others")
    durable = stored(pinned.unionByName(lasting), "durable")
    rest = rows.join(durable.select("id"), "id", "left_anti").orderBy(F.col("score").desc(), "id").limit(ACTIVE_LOOK).select("id", (-F.col("score")).alias("k"), "score", "content_hash", "embedding")
    active = _collapsed(rest, durable, ACTIVE_KEEP, "rest")
    named = durable.select("id", F.lit("durable").alias("pool")).unionByName(active.select("id", F.lit("active").alias("pool")))
    return stored(named.join(rows.select("id", "imp", "score"), "id"), "named").join(valid.drop("imp", "score"), "id")


def _collapsed(rows: DataFrame, kept: DataFrame, most: int, label: str) -> DataFrame:
    """The first `most` of the bounded rows in order of k that a fold after the kept ones keeps."""
    keys = stored(rows, label)
    looks = hashed(keys)
    free = keys.join(near(looks, kept), "id", "left_anti")
    first = states(free, None, F.col("k")).where("state = 'kept'").orderBy("pos").limit(most).select("id")
    return looks.join(first, "id", "left_semi")


def pool_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("pool", F.coalesce("event_date", F.lit(0.0)), "id")
