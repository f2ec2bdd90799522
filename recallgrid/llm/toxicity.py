"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of character n-grams (code points, A-Z lower-cased) of the text, hashed to
buckets. Grouped counts over the training rows give each feature's log-count ratio r between toxic and
other documents; the FEATURES of either sign that stand out most by r over its standard error are kept,
presence is multiplied by r, and logistic regression with an L2 penalty is fitted to that, both classes
weighing the same in all. The training rows are a sample of at most
max_rows labelled rows, the first by a hash of doc_id; every row of a table is scored, whole text.

Defined results: null text counts as empty; an empty text gets the score of no feature; rows without a
label don't train; without labelled rows of both kinds every score is their share (0.5 without any);
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices, text_bytes, tidy
from .storage import stored

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 18
FEATURES = 2048
MAX_ROWS = 12_000
PENALTY = 1e-3
ROUNDS = 200


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts (where they aren't UTF-8, bytes) and the len + 1 offsets into them."""
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    except UnicodeDecodeError:
        return data.astype(np.uint32), offsets
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, before[offsets]


def _buckets(points: np.ndarray, offsets: np.ndarray):
    """For each n-gram size the bucket of the n-gram at each character (the last ones of a text: -1)."""
    h = points + np.uint32(32) * ((points >= 65) & (points <= 90)).astype(np.uint32)
    low = h
    for n in range(2, max(SIZES) + 1):
        if len(h) <= 1:
            break
        h = h[:-1] * np.uint32(0x01000193) + low[n - 1 :]
        if n in SIZES:
            out = (((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
            for back in range(1, n):  # n-grams that would reach into the next text
                at = offsets[1:] - back
                at = at[(at >= offsets[:-1]) & (at < len(out))]
                out[at] = -1
            yield out


def _counted(batches):
    counts = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            points, at = characters(*text_bytes(part.column("text")))
            every = list(_buckets(points, at))
            for i, label in enumerate(part.column("label").to_pylist()):
                there = np.zeros(1 << BUCKET_BITS, dtype=bool)
                for out in every:
                    own = out[at[i] : at[i + 1]]
                    there[own[own >= 0]] = True
                counts[label] += there
    for label in (0, 1):
        some = np.flatnonzero(counts[label])
        for k in range(0, len(some), 1 << 16):
            mine = some[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), label, dtype=np.int32)), pa.array(mine.astype(np.int32)), pa.array(counts[label][mine])], names=["label", "bucket", "n"])


def _present(texts: pa.Array, index: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each kept feature that a text has, each once."""
    points, at = characters(*text_bytes(texts))
    pairs = [np.empty(0, dtype=np.int64)]
    for found in _buckets(points, at):
        kept = index[found]  # bucket -1 is the last entry, which is never kept
        hits = np.flatnonzero(kept < features)
        pairs.append(np.unique((np.searchsorted(at, hits, side="right") - 1) * np.int64(features) + kept[hits]))
    pairs = np.unique(np.concatenate(pairs))
    return pairs // max(1, features), pairs % max(1, features)


def _fit(x: np.ndarray, y: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and intercept, by accelerated gradient steps on the weighted log loss."""
    n, k = x.shape
    z = np.concatenate([x * scale.astype(np.float32), np.ones((n, 1), dtype=np.float32)], axis=1)
    weight = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    v = np.ones(k + 1) / np.sqrt(k + 1)
    for _ in range(30):  # largest eigenvalue, for the step
        u = z.T @ (weight * (z @ v.astype(np.float32))).astype(np.float32)
        v = u / np.linalg.norm(u)
    step = 1 / (0.25 * float(np.linalg.norm(u)) / n + PENALTY)
    w = np.zeros(k + 1)
    look, t = w.copy(), 1.0
    ridge = np.full(k + 1, PENALTY)
    ridge[-1] = 0
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(z @ look.astype(np.float32), -60, 60)))
        new = look - step * (z.T @ (weight * (p - y)).astype(np.float32) / n + ridge * look)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look, w = new + (before - 1) / t * (new - w), new
    return w[:-1] * scale, float(w[-1])


def sample(labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most max_rows of labels(doc_id, label), the first by a hash of doc_id: small enough to broadcast."""
    return labels.select("doc_id", "label").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows)


def train(rows: DataFrame, max_rows: int = MAX_ROWS, features: int = FEATURES) -> dict:
    """The model fitted to rows(doc_id, text, label 0 or 1): feature index by bucket, weights, intercept."""
    picked = rows.where("label in (0, 1)").select("doc_id", "text", F.col("label").cast("int"))
    picked = stored(picked.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_rows), "training").repartition(8)
    total = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
    if len(total) < 2:
        return {"index": None, "weights": None, "intercept": None, "share": float(1 in total) if total else 0.5}
    counts = picked.select("text", "label").mapInArrow(tidy(_counted), "label int, bucket int, n long")
    sides = counts.groupBy("bucket").agg(*(F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in (0, 1)))
    ratio = F.log((F.col("n1") + 1) / (total[1] + 2)) - F.log((F.col("n0") + 1) / (total[0] + 2))
    error = F.sqrt(1 / (F.col("n1") + 1) + 1 / (F.col("n0") + 1))
    best = sides.select("bucket", ratio.alias("r"), (F.abs(ratio) / error).alias("z")).where("r <> 0").orderBy(F.col("z").desc(), "bucket").limit(features).collect()
    index = np.full((1 << BUCKET_BITS) + 1, len(best), dtype=np.int16)
    index[[r["bucket"] for r in best]] = np.arange(len(best))
    scale = np.array([r["r"] for r in best])
    k = len(best)
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def bits(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                row, feature = _present(part.column("text"), shared.value, k)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                there = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), there], names=["doc_id", "label", "there"])

    data = picked.mapInArrow(tidy(bits), "doc_id long, label int, there array<int>").collect()
    data.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["there"]))
    x = np.zeros((len(data), k), dtype=np.float32)
    for i, r in enumerate(data):
        x[i, r["there"]] = 1
    weights, intercept = _fit(x, np.array([r["label"] for r in data], dtype=np.float64), scale)
    return {"index": index, "weights": weights, "intercept": intercept, "share": None, "ratios": scale}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs."""
    if model["weights"] is None:
        return docs.select("doc_id", F.lit(float(model["share"])).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                row, feature = _present(part.column("text"), m["index"], len(m["weights"]))
                z = np.bincount(row, m["weights"][feature], part.num_rows) + m["intercept"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")
