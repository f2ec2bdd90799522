"""Vector codes: product quantization with integer codebooks and kd-trees.

Components become integers, vectors are cut into equal parts, and a codebook of at most ENTRIES entries
is refined for each part. Each round a kd-tree per codebook is broadcast (at most ENTRIES entries of one
part). Tasks search it by branch and bound, many vectors at once: a box is entered unless it is farther
than the best entry so far, so that boxes at the same distance are entered too and of equally near entries
the one with the lower index is found. Tasks add up their vectors by entry in integers, the sums are added
by Spark, and nothing but the codebooks' own sums reaches the driver. Equal vectors cost no more than
others, and no step groups rows by what they hold.

All distances are exact: in doubles while squares stay below 2^53, else in Python integers.

Defined results: rows whose vector is null, empty, or holds a null, a NaN or an infinity are dropped, and
so are rows of another length than the kept row with the smallest vec_id (null ids come last, ties by
vector); a length that isn't a multiple of PARTS is cut at floor(k * length / PARTS); repeated rows count
as often as they are there; an empty table gives no rows. A component of 2^53 or more is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import tidy
from .storage import arrow_rows, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAF = 16
ROWS_A_BATCH = 8192
HOT_SHARE = 500


class KdTree:
    """Nearest of some integer points; lower index first among equals."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.squares = (points * points).sum(axis=1)
        self.root = self._split(np.arange(len(points)))

    def _split(self, index: np.ndarray):
        here = self.points[index]
        box = here.min(axis=0), here.max(axis=0)
        width = box[1] - box[0]
        axis = int(np.argmax(width))
        if len(index) <= LEAF or not width[axis]:
            return box, None, index
        value = np.sort(here[:, axis])[(len(index) - 1) // 2]
        if value == box[1][axis]:
            value = here[:, axis][here[:, axis] < value].max()
        left = here[:, axis] <= value
        return box, (axis, value, self._split(index[left]), self._split(index[~left])), None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """index and squared distance of the nearest point for each row of x."""
        far = np.inf if x.dtype == np.float64 else 1 << 2000
        best, found = np.full(len(x), far, dtype=x.dtype), np.zeros(len(x), dtype=np.int64)
        squares = (x * x).sum(axis=1)

        def visit(node, rows: np.ndarray) -> None:
            (low, high), inner, index = node
            out = np.maximum(np.maximum(low - x[rows], x[rows] - high), 0)
            rows = rows[(out * out).sum(axis=1) <= best[rows]]
            if not len(rows):
                return
            if inner is None:
                d = squares[rows][:, None] - 2 * (x[rows] @ self.points[index].T) + self.squares[index][None, :]
                k = np.argmin(d, axis=1)
                d, k = d[np.arange(len(rows)), k], index[k]
                better = (d < best[rows]) | ((d == best[rows]) & (k < found[rows]))
                best[rows[better]], found[rows[better]] = d[better], k[better]
                return
            axis, value, left, right = inner
            near = x[rows, axis] <= value
            visit(left, rows[near])
            visit(right, rows[~near])
            visit(right, rows[near])
            visit(left, rows[~near])

        visit(self.root, np.arange(len(x)))
        return found, best


def bounds(length: int) -> list[tuple[int, int]]:
    edges = [k * length // PARTS for k in range(PARTS + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def exact(values: np.ndarray, length: int) -> np.ndarray:
    """values in a type in which squared distances of vectors of this length are exact."""
    largest = int(np.abs(values).max()) if values.size else 0
    return values.astype(np.float64) if 4 * largest * largest * max(length, 1) < 1 << 53 else values.astype(object)


def _whole_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("embedding")
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null is NaN
        ends = np.concatenate([[0], np.cumsum(size)])
        odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        keep = (size > 0) & (odd[ends[1:]] == odd[ends[:-1]])
        scaled = np.floor(values[np.repeat(keep, size)] * SCALE)
        if scaled.size and np.abs(scaled).max() >= 1 << 53:
            raise ValueError("a component is too large to be scaled exactly")
        kept = batch.filter(pa.array(keep))
        grid = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)), pa.array(scaled.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), grid], names=["vec_id", "label", "grid"])


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, grid (array of long) of the rows that are kept."""
    kind = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(tidy(_whole_numbers), f"vec_id {kind['vec_id']}, label {kind['label']}, grid array<long>")


def _matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("grid").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _assign(x: np.ndarray, trees: list[KdTree], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for part, ((a, b), tree) in enumerate(zip(bounds(length), trees, strict=True)):
        both = exact(np.concatenate([x[:, a:b], tree.points.astype(np.int64)]), b - a)
        own = tree if both.dtype == tree.points.dtype else KdTree(both[len(x) :])
        yield part, x[:, a:b], *own.nearest(both[: len(x)])


def _sums(trees, length: int) -> Callable:
    """Rows (slot, value): a slot is a part's entry and a position of it, or the entry's count at position `length`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, x, found, _ in _assign(_matrix(batch, length), trees.value, length):
                n = len(trees.value[part].points)
                table = total.setdefault(part, np.zeros((n, x.shape[1] + 1), dtype=np.int64))
                np.add.at(table, found, np.concatenate([x, np.ones((len(x), 1), dtype=np.int64)], axis=1))
        for part, table in total.items():
            flat = table.reshape(-1)
            there = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), part, dtype=np.int32)), pa.array(there), pa.array(flat[there])], names=["part", "slot", "value"])

    return run


def refined(rows: DataFrame, books: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Each entry replaced by the floored mean of the parts assigned to it; unused entries stay."""
    spark = rows.sparkSession
    trees = spark.sparkContext.broadcast(_trees(books))
    found = rows.select("grid").mapInArrow(tidy(_sums(trees, length)), "part int, slot long, value long").groupBy("part", "slot").agg(F.sum("value").alias("value")).collect()
    trees.destroy()
    out = [b.copy() for b in books]
    sums = [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in books]
    for r in found:
        sums[r["part"]].reshape(-1)[r["slot"]] = r["value"]
    for book, table in zip(out, sums, strict=True):
        used = table[:, -1] > 0
        book[used] = table[used, :-1] // table[used, -1:]
    return out


def _trees(books: list[np.ndarray]) -> list[KdTree]:
    return [KdTree(exact(b, b.shape[1])) for b in books]


def _codes(trees, length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            code, error = np.empty((len(batch), PARTS), dtype=np.uint8), 0
            for part, _, found, best in _assign(_matrix(batch, length), trees.value, length):
                code[:, part], error = found, error + best
            text = code.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]), pa.array([int(e) for e in error], pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return run


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows(label, error, ...) with label_error: error summed over equal labels, nulls together.

    Sums of labels with more than a HOT_SHARE-th of all rows (fewer than HOT_SHARE labels) are broadcast, so
    that their rows stay where they are; those of other labels are joined by label.
    """
    sums = stored(rows.groupBy(F.col("label").alias("s_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label_sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    same = F.col("label").eqNullSafe(F.col("s_label"))
    often = F.broadcast(sums.where(hot).drop("n"))
    return rows.join(often, same).drop("s_label").unionByName(rows.join(often, same, "left_anti").join(sums.where(~hot).drop("n"), same).drop("s_label"))


def quantize(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error of the kept rows of vectors(vec_id, embedding, label), and the final codebooks by part."""
    spark = vectors.sparkSession
    with arrow_rows(spark, ROWS_A_BATCH):
        rows = stored(whole_numbers(vectors), "grid")
        order = [F.col("vec_id").asc_nulls_last(), F.col("grid")]
        first = rows.orderBy(*order).limit(1).collect()
        length = len(first[0]["grid"]) if first else 0
        rows = rows.where(F.size("grid") == length)
        start = [r["grid"] for r in rows.orderBy(*order).limit(entries).collect()]
        start = np.array(start, dtype=np.int64).reshape(len(start), length)
        books = [start[:, a:b] for a, b in bounds(length)]
        for _ in range(rounds if first else 0):
            books = refined(rows, books, length)
        trees = spark.sparkContext.broadcast(_trees(books) if first else [])
        coded = rows.mapInArrow(tidy(_codes(trees, length)), f"vec_id {dict(rows.dtypes)['vec_id']}, label {dict(rows.dtypes)['label']}, code string, error long")
        return stored(coded, "codes"), books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()
