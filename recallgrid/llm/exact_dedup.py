"""Exact duplicates by composable polynomial fingerprints.

A text is cut into chunks; a chunk's fingerprint is a polynomial in its bytes modulo a prime, and two
neighbours combine as h(left) * base ** len(right) + h(right), so chunks hash in any order and place.
Texts with equal fingerprints and lengths are then compared chunk by chunk with the row that would
stay: a group's texts stream past it, in tasks of about COPIES_PER_TASK. Fingerprints for which any
chunk differs are split by the digest of the text.

Defined results: null text counts as empty; a null doc_id is smaller than any other; of rows with equal
text and equal doc_id one stays; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import ASCII_LOWER, slices, text_bytes, tidy
from .storage import packed, stored

MODULI = (2147483647, 2147483629)
BASES = (1000003, 1566083941)
CHUNK_BYTES = 1 << 16
PARALLEL_BYTES = 32 << 20
COPIES_PER_TASK = 128
KEY = ["fp0", "fp1", "n_bytes"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def chunk_fingerprint(chunk: np.ndarray, base: int, modulus: int, table: dict) -> tuple[int, int]:
    """(hash, base ** length) of at most CHUNK_BYTES bytes. table keeps the powers between calls."""
    if (base, modulus) not in table:
        out = [1]
        for _ in range(CHUNK_BYTES):
            out.append(out[-1] * base % modulus)
        table[base, modulus] = np.array(out[::-1], dtype=np.int64)
    weights = table[base, modulus]
    n = len(chunk)
    return int(((chunk.astype(np.int64) + 1) * weights[len(weights) - n :]).sum() % modulus), int(weights[len(weights) - 1 - n])


def combine(left: tuple[int, int], right: tuple[int, int], modulus: int) -> tuple[int, int]:
    """The fingerprint of the concatenation; associative, with (0, 1) for the empty text."""
    return (left[0] * right[1] + right[0]) % modulus, left[1] * right[1] % modulus


def fingerprint(data: np.ndarray, base: int, modulus: int, table: dict) -> int:
    parts = (chunk_fingerprint(data[i : i + CHUNK_BYTES], base, modulus, table) for i in range(0, len(data), CHUNK_BYTES))
    return reduce(lambda a, b: combine(a, b, modulus), parts, (0, 1))[0]


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, at = text_bytes(part.column("text"))
            data = ASCII_LOWER[data]
            yield part, [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _whole(moduli: tuple[int, int]):
    def run(batches):
        table: dict = {}
        for part, texts in _normalised(batches):
            fps = [pa.array([fingerprint(x, b, m, table) for x in texts], pa.int64()) for b, m in zip(BASES, moduli, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *fps, pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts])],
                names=["doc_id", *KEY, "text_sha256"],
            )

    return run


def _parts(moduli: tuple[int, int]):
    def run(batches):
        table: dict = {}
        for part, texts in _normalised(batches):
            pairs = [[reduce(lambda a, b, m=m: combine(a, b, m), (chunk_fingerprint(x[i : i + CHUNK_BYTES], b, m, table) for i in range(0, len(x), CHUNK_BYTES)), (0, 1)) for x in texts] for b, m in zip(BASES, moduli, strict=True)]
            columns = [pa.array([p[k] for p in side], pa.int64()) for side in pairs for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "text_hash", "n_bytes", "text_sha256", "part")), *columns], names=["doc_id", "text_hash", "n_bytes", "text_sha256", "part", "h0", "p0", "h1", "p1"])

    return run


def fingerprints(docs: DataFrame, moduli: tuple[int, int] = MODULI, parallel_bytes: int = PARALLEL_BYTES) -> DataFrame:
    """doc_id, fp0, fp1, n_bytes, text_sha256 of each row, after lower-casing A-Z.

    Texts above parallel_bytes are dealt out in parts, hashed by many tasks and combined in order.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text")
    schema = "doc_id long, fp0 long, fp1 long, n_bytes long, text_sha256 string"
    small = rows.where(size <= parallel_bytes).mapInArrow(tidy(_whole(moduli)), schema)
    step = max(1, parallel_bytes // 4)
    parts = (
        rows.where(size > parallel_bytes)
        .select("doc_id", "text", F.xxhash64("text").alias("text_hash"), size.cast("long").alias("n_bytes"), F.sha2(F.translate("text", UPPER, LOWER), 256).alias("text_sha256"))
        .select("doc_id", "text_hash", "n_bytes", "text_sha256", F.posexplode(F.transform(F.sequence(F.lit(0), F.length("text") - 1, F.lit(step)), lambda i: F.substring(F.col("text"), i + 1, F.lit(step)))).alias("part", "text"))
        .repartition("doc_id", "text_hash", "part")
        .mapInArrow(tidy(_parts(moduli)), "doc_id long, text_hash long, n_bytes long, text_sha256 string, part int, h0 long, p0 long, h1 long, p1 long")
    )
    order = F.array_sort(F.collect_set(F.struct("part", "h0", "p0", "h1", "p1")))

    def fold(k: int):
        return F.aggregate(order, F.lit(0).cast("long"), lambda h, x: (h * x[f"p{k}"] + x[f"h{k}"]) % F.lit(moduli[k])).alias(f"fp{k}")

    copies = F.explode(F.sequence(F.lit(1), F.col("n")))  # a repeated row gives each of its parts again
    large = (
        parts.groupBy("doc_id", "text_hash", "n_bytes", "text_sha256")
        .agg(fold(0), fold(1), F.sum((F.col("part") == 0).cast("int")).alias("n"))
        .select("doc_id", *KEY, "text_sha256", copies)
        .drop("col")
    )
    return small.unionByName(large)


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints with unequal texts among rows(fp0, fp1, n_bytes, piece, kind, text) in order; kind 0 is the text that stays."""
    at_work, own = None, None
    for part, texts in _normalised(batches):
        group = list(zip(*(part.column(c).to_pylist() for c in (*KEY, "piece")), strict=True))
        kind, found = part.column("kind").to_pylist(), set()
        for i, x in enumerate(texts):
            if kind[i] == 0:
                at_work, own = group[i], x.copy()
            elif group[i] != at_work or not _equal(own, x):
                found.add(group[i][:3])
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=KEY)


def _equal(a: np.ndarray, b: np.ndarray) -> bool:
    return len(a) == len(b) and all(np.array_equal(a[i : i + CHUNK_BYTES], b[i : i + CHUNK_BYTES]) for i in range(0, len(a), CHUNK_BYTES))


def _grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(..., salt) with n and stays (the largest doc_id and row_id) of their group by keys, both null for a row alone.

    A group's rows are counted by (group, salt), then by group, and what is found is sent back by (group,
    salt): no task gets more of a group than a salt has.
    """
    here = [*keys, "salt"]
    parts = rows.groupBy(*here).agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "row_id")).alias("stays"))
    total = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("stays").alias("stays")).where("n > 1")
    return rows.join(stored(parts.select(*here).join(total, keys), "groups"), here, "left")


def normal_digest() -> Column:
    """Digest of text as it is compared: null as empty, A-Z lower-cased."""
    return F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), 256)


def collisions(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """fp0, fp1, n_bytes of groups whose texts aren't all equal."""
    pieces = F.ceil(F.col("n") / COPIES_PER_TASK)
    same = grouped.where("n > 1")
    others = same.where("row_id <> stays.row_id").select("doc_id", "text_sha256", *KEY, F.pmod(F.xxhash64("doc_id", "text_sha256"), pieces).alias("piece"), F.lit(1).alias("kind")).dropDuplicates(["doc_id", "text_sha256", *KEY])
    stays = same.where("row_id = stays.row_id").select("doc_id", "text_sha256", *KEY, F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"), F.lit(0).alias("kind"))
    wanted = others.unionByName(stays).withColumnsRenamed({"doc_id": "w_id", "text_sha256": "w_sha"}).hint("shuffle_hash")  # a hundred bytes a text are built
    texts = docs.select("doc_id", "text", normal_digest().alias("sha"))
    rows = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("sha") == F.col("w_sha"))).select(*KEY, "piece", "kind", "text")
    dealt = rows.repartition(*KEY, "piece").sortWithinPartitions(*KEY, "piece", "kind")
    return stored(dealt.mapInArrow(tidy(_differing), "fp0 long, fp1 long, n_bytes long").distinct(), "collided")


def exact_duplicates(docs: DataFrame, moduli: tuple[int, int] = MODULI, parallel_bytes: int = PARALLEL_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the largest doc_id stays."""
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = fingerprints(docs, moduli, parallel_bytes).withColumn("row_id", F.monotonically_increasing_id())
    base = stored(base, "fingerprints").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)))
    rows = _grouped(base, KEY)
    collided = collisions(docs, rows)
    if not collided.isEmpty():
        split = base.join(collided.withColumn("split", F.lit(True)), KEY, "left").withColumn("split", F.when(F.col("split"), F.col("text_sha256")).otherwise(F.lit("")))
        rows = _grouped(split, [*KEY, "split"])
    alone = F.col("stays").isNull()
    return rows.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_id") == F.col("stays.row_id"), F.lit(True)).alias("kept"), "text_sha256",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows alike in doc_id and text one stays."""
    found = stored(exact_duplicates(docs), "found")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    often = stored(found.where(stays & (F.col("group_size") > 1)).groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("o_id"), F.col("text_sha256").alias("o_sha")), "often")
    kept = found.where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha")).hint("shuffle_hash")  # a hundred bytes a text are built
    rows = docs.select("doc_id", normal_digest().alias("sha"), packed(docs))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha")), "left_semi")
    if often.isEmpty():
        return rows.select("doc.*")
    again = rows["doc_id"].eqNullSafe(F.col("o_id")) & (F.col("sha") == F.col("o_sha"))
    one = rows.join(often, again, "left_semi").dropDuplicates(["doc_id", "sha"])
    return rows.join(often, again, "left_anti").select("doc.*").unionByName(one.select("doc.*"))
