"""Ledger analytics: decay curve, co-recall graph, supersession strata, projection, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scoring, vector
from .tables import stored

MAX_POINTS, MAX_EDGES, MAX_DEPTH, COLOURS, NEIGHBOURS = 2500, 120, 20, 8, 3
PROJECTION_VERSION = "v2"


def decay_points(facts: DataFrame, now: float) -> DataFrame:
    """id, importance, age in days, half life, score, quarantined flag of facts that aren't superseded."""
    ts = F.coalesce(scoring.moment(F.col("event_date"), F.col("created_at")), F.lit(float(now)))
    imp = F.coalesce(scoring.truthy(F.col("importance")), F.lit(scoring.DEFAULT_IMPORTANCE))
    age = F.greatest(F.lit(0.0), (F.lit(float(now)) - ts) / scoring.DAY)
    return facts.where(schema.decay_population()).select("id", imp.alias("importance"), F.round(age, 1).alias("age"), F.round(scoring.weight_score(F.col("importance"), ts, ts, now), 4).alias("score"), F.col("quarantined_at").isNotNull().alias("q"))


def lifecycle(facts: DataFrame) -> DataFrame:
    """Timestamps rounded to 0.1, 0 as null."""
    r = lambda x: F.round(scoring.truthy(x), 1)
    return facts.select("id", r(F.col("created_at")).alias("c"), r(F.col("invalidated_at")).alias("iv"), r(F.col("quarantined_at")).alias("qt"), r(scoring.moment(F.col("event_date"), F.col("created_at"))).alias("ed"))


def embedded(facts: DataFrame, most: int = MAX_POINTS) -> DataFrame:
    """The newest facts that have a vector."""
    return facts.where(F.col("embedding").isNotNull()).orderBy(F.col("id").desc()).limit(most)


def projection_stamp(facts: DataFrame) -> DataFrame:
    """What tells whether a stored projection is still good."""
    rows = facts.where(F.col("embedding").isNotNull())
    return rows.agg(F.concat_ws(":", F.lit(PROJECTION_VERSION), F.count("*").cast("string"), F.coalesce(F.max("id"), F.lit(0)).cast("string")).alias("stamp"))


def recall_edges(log: DataFrame, facts: DataFrame, most: int = MAX_EDGES) -> DataFrame:
    """The heaviest of recall_pairs."""
    return recall_pairs(log, facts).orderBy(F.col("weight").desc(), "a", "b").limit(most)


def recall_pairs(log: DataFrame, facts: DataFrame) -> DataFrame:
    """a, b, weight: how often two valid facts were answers to the same read. A read has few answers (its limit), so pairs per read are few."""
    reads = log.where("result_ids is not null").select(F.col("id").alias("read"), F.explode(F.array_distinct("result_ids")).alias("fact"))
    alive = reads.join(facts.where(schema.valid()).select(F.col("id").alias("fact")), "fact", "left_semi")
    sets = alive.groupBy("read").agg(F.sort_array(F.collect_set("fact")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("weight"))


def strata(facts: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """head, id, depth: what each valid fact has superseded, directly or in steps; the nearest path counts.

    One equi-join on superseded_by a step over stored tables, until no row is new or `depth` is reached.
    """
    edges = stored(facts.where(F.col("superseded_by").isNotNull()).select(F.col("id").alias("old"), "superseded_by"), "edges")
    ends = facts.where(schema.valid()).select(F.col("id").alias("head"), F.col("id").alias("end"))
    seen = None
    for step in range(1, depth + 1):
        found = ends.join(edges, F.col("end") == F.col("superseded_by")).select("head", F.col("old").alias("id")).distinct()
        new = found if seen is None else found.join(seen, ["head", "id"], "left_anti")
        new = stored(new.withColumn("depth", F.lit(step)), "strata")
        seen = new if seen is None else seen.unionByName(new)
        if new.isEmpty():
            break
        ends = new.select("head", F.col("id").alias("end"))
    return seen.where("id <> head")


def pca3(points: DataFrame) -> DataFrame:
    """id, x, y, z of points(id, embedding): coordinates on the three widest axes of the centred vectors; under 4 points all 0.

    The covariance matrix is summed by Spark; only its size (dimension squared) reaches the driver.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    n = points.agg(F.count("*")).first()[0]
    if n < 4:
        return points.select("id", *(F.lit(0.0).alias(c) for c in "xyz"))
    rows = points.select("id", array_to_vector(vector.as_double(F.col("embedding"))).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(rows).transform(rows)
    out = PCA(k=3, inputCol="c", outputCol="p").fit(centred).transform(centred).select("id", vector_to_array("p").alias("p"))
    return out.select("id", *(F.col("p")[k].alias(c) for k, c in enumerate("xyz")))


def clusters(coords: DataFrame, seed: int = 17) -> DataFrame:
    """id, x, y, z, cluster (from 0 without gaps, largest first) of coords."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = coords.agg(F.count("*").alias("n")).select("n", scoring.target_clusters(F.col("n")).alias("k")).first()
    if not n["n"]:
        return coords.withColumn("cluster", F.lit(0))
    rows = coords.orderBy("id").withColumn("v", array_to_vector(F.array("x", "y", "z")))
    found = KMeans(k=max(2, n["k"]), seed=seed, maxIter=30, featuresCol="v", predictionCol="raw").fit(rows).transform(rows).drop("v") if n["k"] > 1 else rows.withColumn("raw", F.lit(0)).drop("v")
    order = found.groupBy("raw").agg(F.count("*").alias("m")).withColumn("cluster", F.row_number().over(Window.orderBy(F.col("m").desc(), "raw")) - 1)  # one row a cluster
    return found.join(order.select("raw", "cluster"), "raw").drop("raw")


def cluster_stats(placed: DataFrame) -> DataFrame:
    """Size, centroid, mean freshness, spread and covariance of placed(id, x, y, z, cluster, fresh)."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    centre = placed.groupBy("cluster").agg(F.count("*").alias("size"), *(F.avg(c).alias(f"c{c}") for c in "xyz"), F.avg("fresh").alias("fresh"), *(F.covar_pop(a, b).alias(f"cov_{a}{b}") for a, b in pairs))
    apart = F.sqrt(sum((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz"))
    spread = placed.drop("fresh").join(centre.select("cluster", "cx", "cy", "cz"), "cluster").groupBy("cluster").agg(F.avg(apart).alias("spread"))
    return centre.join(spread, "cluster")


def neighbours(centres: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """a, b, both ways: each centre with its nearest ones. Centres are at most 14, so the self-join is small by rule."""
    other = centres.select(F.col("cluster").alias("b"), *(F.col(f"c{c}").alias(f"o{c}") for c in "xyz"))
    apart = sum((F.col(f"c{c}") - F.col(f"o{c}")) ** 2 for c in "xyz")
    near = centres.join(other, F.col("cluster") != F.col("b")).withColumn("nth", F.row_number().over(Window.partitionBy("cluster").orderBy(apart, "b"))).where(F.col("nth") <= most)
    one = near.select(F.col("cluster").alias("a"), "b")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def colours(edges: list[tuple[int, int]], n: int) -> dict[int, int]:
    """A colour for each of n (at most 14) clusters, unlike its neighbours' where possible; the busiest first."""
    near: dict[int, set[int]] = {k: set() for k in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out: dict[int, int] = {}
    for k in sorted(near, key=lambda k: (-len(near[k]), k)):
        taken = {out[j] for j in near[k] if j in out}
        out[k] = next((c for c in range(COLOURS) if c not in taken), k % COLOURS)
    return out


def landscape(facts: DataFrame, log: DataFrame, now: float) -> dict[str, DataFrame]:
    """nodes, clouds, edges, strata of the valid facts that have a place."""
    points = embedded(facts.where(schema.valid()))
    placed = clusters(pca3(points))
    fresh = decay_points(facts, now).select("id", F.col("score").alias("fresh"), "importance")
    nodes = placed.join(fresh, "id").join(lifecycle(facts), "id")
    return {"nodes": nodes, "clouds": cluster_stats(nodes), "edges": recall_edges(log, facts), "strata": strata(facts)}


def gram_means(points: DataFrame) -> DataFrame:
    """id, row_mean, grand_mean of the inner products of points(id, embedding), as double-centring needs them.

    The mean of a row's products is its product with the mean vector, so no pair is made.
    """
    rows = points.select("id", vector.as_double(F.col("embedding")).alias("v"))
    each = rows.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    mean = each.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"))  # one row, an entry a dimension
    return rows.crossJoin(mean).select("id", vector.dot(F.col("v"), F.col("mean")).alias("row_mean"), vector.dot(F.col("mean"), F.col("mean")).alias("grand_mean"))
