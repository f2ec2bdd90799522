"""Importance resampling towards a target distribution.

Documents and target texts are bags of hashed word runs (1 to 3 words, CRC-32 modulo BUCKETS). Two arrays
of bucket counts, one of the raw corpus and one of the target, give an array of gains; a document's weight
is the sum of its features' gains, and Gumbel noise from a hash of its id turns the top k of weight plus
noise into a sample without replacement. The k-th key of (score descending, doc_id) is found by radix
selection: histograms of key digits, most significant first, each a grouped count of at most 2^DIGIT_BITS
rows, until a digit's rows are just those still wanted. Only rows up to that key are range-sorted and ranked.

CRC-32 is linear, so a word's checksum is an exclusive or of table entries by byte and distance from the
word's end, and that of a run follows from those of its words by shifts, all as array work.

Defined results: a null text has no words; a null doc_id hashes as an empty one and is the smallest;
rows alike in doc_id and score are ranked in an order of their own, fixed within a run; an empty table
gives no rows. Texts are read whole, long ones in pieces of PIECE_BYTES that end between words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import ASCII_LOWER, slices, text_bytes, tidy
from .storage import arrow_rows, stored

BUCKETS, LONGEST_RUN = 10_000, 3
MIN_WORDS, DRAWN_PERCENT, SEED = 20, 5, 42
DIGIT_BITS = 12
PIECE_BYTES = 1 << 22
ROWS_A_BATCH = 2000
SIGN = 1 << 63

IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True  # after lower-casing A-Z
NEAR = 64


def _byte_table() -> np.ndarray:
    """The checksum's step for each byte, from its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


BYTE = _byte_table()


def _zero_step(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint32(8)) ^ BYTE[x & np.uint32(255)]


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map of tables (4, 256) on 32-bit values."""
    b = lambda k: (x >> np.uint32(8 * k)) & np.uint32(255)
    return tables[0][b(0)] ^ tables[1][b(1)] ^ tables[2][b(2)] ^ tables[3][b(3)]


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables that append n zero bytes: for each n up to NEAR, and for n = NEAR * 2^k."""
    unit = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    near = [unit]
    for _ in range(NEAR):
        near.append(_zero_step(near[-1]))
    far = [near[NEAR]]
    for _ in range(32):
        far.append(_apply(far[-1], far[-1]))
    return np.stack(near[:NEAR]), far


SHIFT, FAR = _shift_tables()
#: By distance from the word's end, what a byte adds.
BY_DISTANCE = np.stack([_apply(SHIFT[n], BYTE) for n in range(NEAR)])


def shifted(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """x with n zero bytes appended, elementwise."""
    base = (n % NEAR).astype(np.int64) * 1024
    flat = SHIFT.reshape(-1)
    b = lambda k: ((x >> np.uint32(8 * k)) & np.uint32(255)).astype(np.int64) + (base + 256 * k)
    out = flat[b(0)] ^ flat[b(1)] ^ flat[b(2)] ^ flat[b(3)]
    rest, k = n // NEAR, 0
    while rest.any():
        odd = (rest & 1).astype(bool)
        out[odd] = _apply(FAR[k], out[odd])
        rest, k = rest >> 1, k + 1
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """raw checksum (from zero) and length of each word in lower-case bytes, and per text the len + 1 word offsets."""
    word = IS_WORD[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start[first], end[last] = word[first], word[last]
    starts = np.flatnonzero(start)
    lengths = np.flatnonzero(end) + 1 - starts
    at = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, dtype=np.uint32), lengths, at
    heads = np.cumsum(lengths) - lengths
    distance = np.repeat(heads + lengths - 1, lengths) - np.arange(lengths.sum())
    raw = np.bitwise_xor.reduceat(BY_DISTANCE.reshape(-1)[np.minimum(distance, NEAR - 1) * 256 + data[word]], heads)
    long = np.flatnonzero(lengths > NEAR)
    for i in long:
        raw[i] = ~np.uint32(zlib.crc32(data[starts[i] : starts[i] + lengths[i]]))
    raw[long] ^= shifted(np.full(len(long), 0xFFFFFFFF, dtype=np.uint32), lengths[long])
    return raw, lengths, at


def run_buckets(raw: np.ndarray, lengths: np.ndarray, doc: np.ndarray, before: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """bucket and text number of each run, for run lengths 1, 2, 3; runs that end in the first `before` words are left out."""
    at, size, last = raw, lengths, np.arange(len(raw))
    for k in range(LONGEST_RUN):
        if k:
            inside = (last + 1 < len(raw)) & (doc[np.minimum(last + 1, len(raw) - 1)] == doc[last]) if len(raw) else np.empty(0, dtype=bool)
            at, size, last = at[inside], size[inside], last[inside] + 1
            n = lengths[last]
            space = shifted(np.full(len(n), BYTE[0x20], dtype=np.uint32), n)
            at, size = shifted(at, n + 1) ^ space ^ raw[last], size + n + 1
        new = last >= before
        crc = ~(shifted(np.full(int(new.sum()), 0xFFFFFFFF, dtype=np.uint32), size[new]) ^ at[new])
        yield crc.astype(np.int64) % BUCKETS, doc[last[new]]


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list]]:
    """Some rows, their word offsets, and per run length (buckets, row): consecutive rows, or a stretch of one long text."""
    for part in slices(batch, "text"):
        data, at = text_bytes(part.column("text"))
        if len(part) > 1 or len(data) <= PIECE_BYTES:
            raw, lengths, ends = words(ASCII_LOWER[data], at)
            yield part, np.diff(ends), list(run_buckets(raw, lengths, np.repeat(np.arange(len(part)), np.diff(ends))))
            continue
        raw, lengths, begin = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64), 0
        while begin < len(data):
            stop = begin + PIECE_BYTES
            while stop < len(data) and not len(gaps := np.flatnonzero(~IS_WORD[ASCII_LOWER[data[stop : stop + PIECE_BYTES]]])):
                stop += PIECE_BYTES
            stop = min(len(data), stop + int(gaps[0])) if stop < len(data) else len(data)
            r, n, ends = words(ASCII_LOWER[data[begin:stop]], np.array([0, stop - begin]))
            raw, lengths, kept = np.concatenate([raw, r]), np.concatenate([lengths, n]), len(raw)
            yield part, np.diff(ends), list(run_buckets(raw, lengths, np.zeros(len(raw), dtype=np.int64), kept))
            raw, lengths, begin = raw[1 - LONGEST_RUN :], lengths[1 - LONGEST_RUN :], stop


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in texts(text): counted per task, then summed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, _, runs in _pieces(batch):
                for buckets, _ in runs:
                    total += np.bincount(buckets, minlength=BUCKETS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])

    with arrow_rows(texts.sparkSession, ROWS_A_BATCH):
        rows = texts.select("text").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the corpus) by bucket, in doubles."""
    all_raw, all_target = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(float(t + 1) * all_raw / (float(s + 1) * all_target))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for part, n_words, runs in _pieces(batch):
                size = len(part)
                row = np.zeros((3, size), dtype=np.int64)
                row[0] = n_words
                for buckets, doc in runs:
                    row[1] += np.bincount(doc, minlength=size)
                    ends = np.searchsorted(doc, np.arange(size + 1))
                    row[2] += np.diff(np.concatenate([[0], np.cumsum(gain[buckets])])[ends])
                if size == 1 and ids and ids[-1] is part:
                    found[-1] += row  # a further stretch of the same text
                else:
                    ids.append(part)
                    found.append(row)
            if ids:
                table = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([p.column("doc_id") for p in ids]), *map(pa.array, table)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column) -> Column:
    """floor(1000 times a standard Gumbel value) that depends on doc_id and SEED alone."""
    text = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def up_to_kth(rows: DataFrame, keys: list[str], k: int) -> Column | None:
    """Condition of the k first rows in ascending order of the long columns keys, None if that is all of them.

    A key is looked at as 64 bits, digit by digit from the first bit in which the rows left differ.
    """
    if k <= 0:
        return F.lit(False)
    prefix, chosen = F.lit(True), []
    for key in keys:
        bits_of = F.col(key).bitwiseXOR(F.lit(-SIGN))  # unsigned order
        low, high, n = rows.where(prefix).agg(F.min(key), F.max(key), F.count("*")).first()
        if n <= k:
            break
        low, high = low + SIGN, high + SIGN
        left = (low ^ high).bit_length()
        head = low >> left
        while left:
            step = min(DIGIT_BITS, left)
            digit = F.shiftrightunsigned(bits_of, left - step).bitwiseAND(F.lit((1 << step) - 1))
            here = F.lit(True) if left == 64 else F.shiftrightunsigned(bits_of, left) == F.lit(head)
            counts = rows.where(prefix & here).groupBy(digit.alias("digit")).count().collect()
            for found, n in sorted((r["digit"], r["count"]) for r in counts):
                if n >= k:
                    break
                k -= n
            head, left = head << step | found, left - step
            if n == k:
                break
        bound = (((head + 1) << left) - 1) - SIGN
        chosen.append((key, bound))
        if n == k:
            break
        prefix = prefix & (F.col(key) == F.lit(bound))
    if not chosen:
        return None
    *equal, (key, bound) = chosen
    out = F.col(key) <= F.lit(bound)
    for key, bound in reversed(equal):
        out = (F.col(key) < F.lit(bound)) | (F.col(key) == F.lit(bound)) & out
    return out


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with rank 1, 2, 3... in ascending order of keys: dealt to ranges of the keys, numbered in each after those before it."""
    dealt = stored(rows.repartitionByRange(*keys).withColumn("in_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("in_range").agg(F.count("*").alias("in_all"))
    before = F.coalesce(F.sum("in_all").over(Window.orderBy("in_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    nth = F.row_number().over(Window.partitionBy("in_range").orderBy(*keys))
    return dealt.withColumn("rank", nth).join(sizes.select("in_range", before.alias("in_before")), "in_range").withColumn("rank", (F.col("rank") + F.col("in_before")).cast("long")).drop("in_range", "in_before")


def resample(docs: DataFrame, target: DataFrame, min_words: int = MIN_WORDS, percent: int = DRAWN_PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs(doc_id, text), towards target(text).

    Drawn are floor(percent * N / 100) of the N rows of min_words words or more; the others have a null rank.
    """
    with arrow_rows(docs.sparkSession, ROWS_A_BATCH):
        scored = weights(docs, gains(bucket_counts(docs), bucket_counts(target)))
        scored = scored.withColumns({"score": F.col("weight") + noise(F.col("doc_id")), "tie": F.monotonically_increasing_id()})
        scored = stored(scored.withColumns({"key": -F.col("score"), "id_key": F.coalesce("doc_id", F.lit(-SIGN))}), "scored")
    keys = ["key", "id_key", "tie"]
    able = F.col("n_words") >= min_words
    k = scored.where(able).count() * percent // 100
    drawn = up_to_kth(scored.where(able), keys, k)
    drawn = able if drawn is None else able & drawn
    out = ["doc_id", "n_features", "weight", "score"]
    first = ranked(scored.where(drawn), keys).select(*out, "rank")
    return first.unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
