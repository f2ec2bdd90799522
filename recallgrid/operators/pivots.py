"""Exact similarity join of vectors at length 1: pivots cut the sphere into cells, only cells within reach meet.

A dot product above the cutoff is a distance below r = sqrt(2 - 2 * cutoff). Each vector lies in the cell
of its nearest pivot (at most PIVOTS of them, broadcast). Another vector y can be that close to one of cell
p only if it is within r of the half space nearer to p than to y's own pivot, and, by the triangle
inequality, if its distance to p is at most that of p's farthest vector plus r; it goes to those cells and
no other. Equal vectors are one vector here. A cell's two sides are dealt in pieces, and a piece of one
side meets a piece of the other in one task, which holds the first and streams the second; the work of a
task is bounded, and vectors without any structure share all pairs out over such tasks.

Dot products are taken in blocks; those within EPS of the cutoff again one by one, in the order in which
functions.vector.dot adds. Vectors of different lengths are never close.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

PIVOTS, CELL_ROWS, FEW = 256, 4096, 1024
PIECE_ROWS, PIECE_OTHERS = 8192, 32_768
EPS, AT_ONCE = 1e-9, 1024
KEY = ["cell", "piece", "part"]


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of a batch, those of one length together."""
    sizes = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[starts[at][:, None] + np.arange(d)[None, :]]


def first_met(x: np.ndarray, y: np.ndarray, first: np.ndarray, cutoff: float) -> np.ndarray:
    """For each vector of x the smallest `first` of the vectors of y that are close, or the largest long."""
    none = np.iinfo(np.int64).max
    out = np.full(len(x), none, dtype=np.int64)
    for k in range(0, len(y), AT_ONCE):
        part, ids = y[k : k + AT_ONCE], first[k : k + AT_ONCE]
        dots = x @ part.T
        met = dots > cutoff + EPS
        for i, j in zip(*np.nonzero(np.abs(dots - cutoff) <= EPS)):
            s = 0.0
            for a, b in zip(x[i].tolist(), part[j].tolist(), strict=True):
                s = s + a * b
            met[i, j] = s > cutoff
        rows = np.flatnonzero(met.any(axis=1))
        if len(rows):
            out[rows] = np.minimum(out[rows], np.where(met[rows], ids[None, :], none).min(axis=1))
    return out


def _found(u: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    there = met < np.iinfo(np.int64).max
    return pa.RecordBatch.from_arrays([pa.array(u[there]), pa.array(met[there])], names=["u", "met"])


def _with_few(few: DataFrame, many: DataFrame, cutoff: float) -> DataFrame:
    """u, met for at most FEW vectors: they go to the others."""
    held: dict[int, tuple[list, list]] = {}
    for r in few.collect():
        us, vs = held.setdefault(len(r["unit"]), ([], []))
        us.append(r["u"])
        vs.append(r["unit"])
    given = few.sparkSession.sparkContext.broadcast({d: (np.array(us, dtype=np.int64), np.array(vs, dtype=np.float64)) for d, (us, vs) in held.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("first").to_numpy()
            for at, y in _matrices(batch, "unit"):
                if y.shape[1] in given.value:
                    u, x = given.value[y.shape[1]]
                    yield _found(u, first_met(x, y, first[at], cutoff))

    return many.select("unit", "first").mapInArrow(run, "u long, met long")


def _cells(pivots: np.ndarray, radius: np.ndarray | None, r: float):
    """Adds cells: the own cell of a vector with its distance, or, given the cells' radii, all cells within reach."""
    apart = np.sqrt(np.maximum(0, ((pivots[:, None] - pivots[None]) ** 2).sum(axis=2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list = [None] * len(batch)
            far = np.zeros(len(batch))
            for at, x in _matrices(batch, "unit"):
                if x.shape[1] != pivots.shape[1]:  # a cell for each other length
                    for i in at:
                        cells[i] = [-1 - x.shape[1]]
                    continue
                square = np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)[None])
                own = square.argmin(axis=1)
                if radius is None:
                    far[at] = np.sqrt(square[np.arange(len(at)), own])
                    near = [[int(k)] for k in own]
                else:
                    beyond = square - square[np.arange(len(at)), own][:, None]
                    fit = (beyond <= 2 * r * apart[own] + EPS) & (np.sqrt(square) <= radius[None] + r + EPS)
                    near = [np.flatnonzero(f).tolist() for f in fit]
                for i, c in zip(at, near, strict=True):
                    cells[i] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32())), pa.array(far)], names=[*batch.schema.names, "cells", "far"])

    return run


def _meet(cutoff: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """u, met of rows(cell, piece, part, kind, n, unit) in order: kind 0 are held, kind 1 stream by."""
        at_work, held, us, vectors = None, None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEY), strict=True))
            kinds, ns = batch.column("kind").to_numpy(), batch.column("n").to_numpy()
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or kinds[i] != kinds[i - 1]), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if keys[a] != at_work:
                    at_work, held, us, vectors = keys[a], None, [], []
                here = [(ns[a:b][at], v) for at, v in _matrices(batch.slice(a, b - a), "unit")]
                if kinds[a] == 0:
                    us += [n for n, _ in here]
                    vectors += [v for _, v in here]
                    continue
                if held is None:
                    held = (np.concatenate(us), np.concatenate(vectors)) if us else ()
                if held:
                    for n, v in here:
                        yield _found(held[0], first_met(held[1], v, n, cutoff))

    return run


def _through_cells(few: DataFrame, many: DataFrame, n: int, cutoff: float) -> DataFrame:
    r = math.sqrt(max(0.0, 2 - 2 * cutoff)) + EPS
    length = few.groupBy(F.size("unit").alias("d")).count().orderBy(F.col("count").desc(), "d").first()["d"]
    chosen = few.where(F.size("unit") == length).orderBy(F.xxhash64("unit"), "u").limit(min(PIVOTS, n // CELL_ROWS + 1)).collect()
    pivots = np.array([x["unit"] for x in chosen], dtype=np.float64)
    own = few.select("u", "unit").mapInArrow(_cells(pivots, None, r), "u long, unit array<double>, cells array<int>, far double")
    own = stored(own.select("u", "unit", F.get("cells", 0).alias("cell"), "far"), "own")
    sizes = own.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    radius = np.full(len(pivots), -np.inf)
    for x in sizes.where("cell >= 0").collect():
        radius[x["cell"]] = x["far"]
    theirs = many.select("first", "unit").mapInArrow(_cells(pivots, radius, r), "first long, unit array<double>, cells array<int>, far double")
    theirs = stored(theirs.select("first", "unit", F.explode("cells").alias("cell")), "theirs")
    both = sizes.join(theirs.groupBy("cell").agg(F.count("*").alias("m")), "cell")
    dealt = stored(both.select("cell", F.ceil(F.col("n") / PIECE_ROWS).cast("int").alias("pieces"), F.ceil(F.col("m") / PIECE_OTHERS).cast("int").alias("parts")), "cells")
    counted = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    ours = own.join(dealt, "cell").select("cell", F.pmod(F.xxhash64("u"), F.col("pieces")).cast("int").alias("piece"), counted("parts").alias("part"), F.lit(0).alias("kind"), F.col("u").alias("n"), "unit")
    others = theirs.join(dealt, "cell").select("cell", counted("pieces").alias("piece"), F.pmod(F.xxhash64("first", "unit"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("first").alias("n"), "unit")
    met = ours.unionByName(others).repartition(*KEY).sortWithinPartitions(*KEY, "kind")
    return met.mapInArrow(_meet(cutoff), "u long, met long")


def first_close(rows: DataFrame, others: DataFrame, cutoff: float) -> DataFrame:
    """unit, met: for the vectors of rows(unit) the smallest id of the vectors of others(id, unit) that are close, where there is one."""
    few = stored(rows.where("unit is not null").select("unit").distinct().withColumn("u", F.monotonically_increasing_id()), "units")
    many = others.where("unit is not null").groupBy("unit").agg(F.min("id").alias("first"))
    n = few.count()
    found = _with_few(few, many, cutoff) if n <= FEW else _through_cells(few, many, n, cutoff)
    return few.join(found.groupBy("u").agg(F.min("met").alias("met")), "u").select("unit", "met")
