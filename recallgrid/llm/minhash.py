"""Near duplicates on word shingles by fast similarity sketches, banding and exact verification.

A sketch has BINS coordinates. In round r each shingle is hashed into one bin (later rounds visit the
bins one after another), where the smallest (round, hash) stays; after 2 * BINS rounds every coordinate
is full, and the share of equal coordinates concentrates about the Jaccard similarity. BANDS groups of
ROWS coordinates are bucket keys. A pair at similarity 0.85 shares no bucket with probability 2e-9,
at 0.8 with 3e-6.

Within a bucket every text is checked against the bucket's smallest id; the links give components;
then every remaining pair of a bucket that lies in different components is checked too: pair by pair
where few are left, unless bit sketches or set sizes exclude it (a pair at the threshold fails the bit
test at SIGMAS standard deviations, about once in 10^10 pairs), and in blocks where many are (there
nothing is excluded). A link left out lies within a component, so components equal those of all bucket
pairs. All links are confirmed on full shingle sets.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; a null
doc_id is linked with nothing and its component is null; rows that share a doc_id are one document for
linking; copies of a set are linked through their smallest doc_id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix, shingle_sets, slices, text_bytes, tidy
from .components import connected_components
from .storage import stored

WIDTH, BINS, BANDS, ROWS = 5, 256, 42, 6
VALUE_BITS = np.uint64(48)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
# Buckets with at most FEW rows outside their largest component are compared pair by pair, others in blocks.
FEW, DENSE_FROM = 16, 8
# A block has about so many rows and bytes of text at most; a text with many candidates is checked against so many a task.
BLOCK, BLOCK_BYTES, PAIRS_TOGETHER = 512, 2 << 20, 256
SIGMAS = 6.5
BIT_COLUMNS = ["b0", "b1", "b2", "b3"]


def sketch(hashes: np.ndarray, ends: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches (one row a set) of sets given one after another with len + 1 offsets."""
    n = len(ends) - 1
    out = np.full((n, bins), FULL, dtype=np.uint64)
    sizes = np.diff(ends)
    doc = np.repeat(np.arange(n), sizes)
    open_docs = sizes > 0
    for r in range(2 * bins):
        if not open_docs.any():
            break
        if r:
            there = open_docs[doc]
            hashes, doc = hashes[there], doc[there]
        x = mix(hashes + np.uint64(0xD1B54A32D192ED03 * (r + 1) & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint64(r) << VALUE_BITS) | (x & ((np.uint64(1) << VALUE_BITS) - np.uint64(1)))
        at = (x >> VALUE_BITS).astype(np.int64) % bins if r < bins else np.full(len(x), r - bins)
        np.minimum.at(out.reshape(-1), doc * bins + at, value)
        rows = np.flatnonzero(open_docs)
        open_docs[rows] = (out[rows] == FULL).any(axis=1)
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    parts = sketches[:, : BANDS * ROWS].reshape(len(sketches), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sketches), BANDS)).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + parts[:, :, k])
    return key.view(np.int64)


def _sketch_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, ends = shingle_sets(*text_bytes(part.column("text")), width)
                sizes = np.diff(ends)
                digests = []
                for salt in (0x1234567, 0x89ABCDE):
                    total = np.concatenate([[0], np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)]).astype(np.uint64)
                    digests.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
                s = sketch(hashes, ends)
                bits = np.packbits((mix(s) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(s).reshape(-1)))
                n_bytes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                columns = [part.column("doc_id"), pa.array(sizes), n_bytes, *map(pa.array, digests), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)), keys]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "n_bytes", "d0", "d1", *BIT_COLUMNS, "bands"])

    return run


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, n_bytes, a 128-bit digest of the set, 256 bits of the sketch and its bucket keys."""
    return docs.select("doc_id", "text").mapInArrow(tidy(_sketch_rows(width)), "doc_id long, n_shingles long, n_bytes long, d0 long, d1 long, b0 long, b1 long, b2 long, b3 long, bands array<long>")


def _linked(width: int, percent: int):
    """Links between rows(a, salt, b, text) in order: rows without b are a's own text, those after it its candidates."""

    def run(batches):
        at_work, own = None, []
        for batch in batches:
            for part in slices(batch, "text"):
                group = list(zip(part.column("a").to_pylist(), part.column("salt").to_pylist(), strict=True))
                ids, found = part.column("b").to_pylist(), []
                hashes, at = shingle_sets(*text_bytes(part.column("text")), width)
                for i, b in enumerate(ids):
                    if group[i] != at_work:
                        at_work, own = group[i], []
                    y = hashes[at[i] : at[i + 1]]
                    if b is None:  # repeated rows of an id may differ in text
                        own += [] if any(np.array_equal(x, y) for x in own) else [y.copy()]
                    elif any(_alike(x, y, percent) for x in own):
                        found.append((group[i][0], b))
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if not len(x) or not len(y):
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose full shingle sets reach percent of Jaccard similarity.

    The candidates of an id are dealt to tasks by PAIRS_TOGETHER, each with one copy of its text, and
    stream past it: a row has one text, and an id with very many candidates is spread over many tasks.
    """
    often = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_TOGETHER).alias("salts"))
    dealt = pairs.join(often, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), "b")
    heads = often.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    rows = dealt.withColumn("doc_id", F.col("b")).unionByName(heads.withColumn("doc_id", F.col("a"))).join(texts, "doc_id").select("a", "salt", "b", "text")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(tidy(_linked(width, percent)), "a long, b long")


def _blocks_linked(width: int, percent: int):
    """Links between the rows of two blocks of a bucket (or within one) that lie in different components."""

    def run(key, rows):
        lo, hi = key[1].as_py(), key[2].as_py()
        ids, block, component = (rows[c].to_numpy() for c in ("id", "block", "component"))
        text = rows["text"].combine_chunks()
        hashes, at = shingle_sets(*text_bytes(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text), width)
        size, doc = np.diff(at), np.repeat(np.arange(len(ids)), np.diff(at))
        both = np.zeros((len(ids), len(ids)), dtype=np.float32)
        order = np.argsort(hashes, kind="stable")
        doc = doc[order]
        heads = np.concatenate([[0], np.flatnonzero(np.diff(hashes[order])) + 1]) if len(hashes) else np.empty(0, dtype=np.int64)
        times = np.diff(np.append(heads, len(hashes)))
        for n in range(2, DENSE_FROM):  # shingles of few rows: pair by pair of places
            mine = doc[heads[times == n][:, None] + np.arange(n)]
            for i in range(n):
                for j in range(i + 1, n):
                    np.add.at(both, (mine[:, i], mine[:, j]), 1)
        both += both.T
        often = np.flatnonzero(times >= DENSE_FROM)
        for k in range(0, len(often), 4096):  # the others: a product of presence matrices
            some = often[k : k + 4096]
            there = np.zeros((len(ids), len(some)), dtype=np.float32)
            there[doc[np.concatenate([np.arange(heads[c], heads[c] + times[c]) for c in some])], np.repeat(np.arange(len(some)), times[some])] = 1
            both += there @ there.T
        linked = 100 * both.astype(np.int64) >= percent * (size[:, None] + size[None, :] - both.astype(np.int64))
        linked &= (component[:, None] != component[None, :]) & (ids[:, None] < ids[None, :])
        linked &= ((block[:, None] == lo) & (block[None, :] == hi)) | ((block[:, None] == hi) & (block[None, :] == lo))
        a, b = np.nonzero(linked)
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return run


def crowded_links(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components in buckets(key, id, component, m, bytes) with many of them.

    A bucket is cut into blocks of about BLOCK rows or BLOCK_BYTES; each pair of blocks is one group, in
    which all rows are compared at once by counting shared shingles, and only links come out.
    """
    cut = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("bytes") / BLOCK_BYTES))
    placed = rows.select("key", "id", "component", cut.alias("blocks"), F.pmod(F.xxhash64("id"), cut).alias("block"))
    dealt = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "id", "block", "component")
    full = dealt.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
    return full.groupBy("key", "lo", "hi").applyInArrow(_blocks_linked(width, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    rows = stored(sketches(docs, width), "sketches")
    named = rows.where("n_shingles > 0 and doc_id is not null")
    sets = named.groupBy("d0", "d1").agg(F.min("doc_id").alias("rep"))
    one = named.join(sets.select("d0", "d1", F.col("rep").alias("doc_id")), ["d0", "d1", "doc_id"], "left_semi").dropDuplicates(["d0", "d1", "doc_id"])
    buckets = one.select(F.col("doc_id").alias("id"), "n_bytes", F.explode("bands").alias("key"))
    leaders = buckets.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").select("key", "leader")
    crowded = stored(buckets.join(leaders, "key"), "buckets")  # key, id, n_bytes, leader of buckets with two documents at least
    wanted = crowded.select("id").distinct()
    # the side that is built has ids only, a hundredth of what the texts beside it have
    texts = stored(docs.select("doc_id", "text").join(wanted.withColumnRenamed("id", "doc_id").hint("shuffle_hash"), "doc_id", "left_semi"), "texts")
    stars = crowded.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(verified(stars, texts, width, percent), "links")
    of = connected_components(links)
    placed = crowded.join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    by_size = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes")).groupBy("key")
    by_size = by_size.agg(F.max_by("component", F.struct("n", "component")).alias("major"), (F.sum("n") - F.max("n")).alias("minors"), F.sum("n").alias("m"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts")).where("parts > 1")
    facts = one.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), *BIT_COLUMNS)
    mixed = stored(placed.drop("n_bytes").join(by_size, "key").join(facts, "id"), "mixed")
    few = mixed.where(F.col("minors") <= FEW)
    other = few.select(F.col("key").alias("o_key"), *(F.col(c).alias(f"o_{c}") for c in ("id", "component", "n", *BIT_COLUMNS)))
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"o_{c}"))) for c in BIT_COLUMNS), F.lit(0))
    mean = BINS * (1 - percent / 100) / 2
    near = apart <= int(mean + SIGMAS * (mean * (1 - mean / BINS)) ** 0.5 + 1)
    sizes = 100 * F.least("n", "o_n") >= percent * F.greatest("n", "o_n")
    fresh = (F.col("id") != F.col("leader")) & (F.col("o_id") != F.col("leader"))  # pairs with the leader are checked already
    rest = few.where("component <> major").join(other, (F.col("key") == F.col("o_key")) & (F.col("component") != F.col("o_component")) & sizes & near & fresh)
    rest = rest.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()
    more = verified(rest, texts, width, percent).unionByName(crowded_links(mixed.where(F.col("minors") > FEW), texts, width, percent))
    of = connected_components(links.unionByName(more))
    return (
        rows.select("doc_id", "n_shingles", "d0", "d1")
        .join(sets, ["d0", "d1"], "left")
        .join(of, F.col("rep") == F.col("id"), "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs whose document stays: one of each group, the smallest doc_id; null ids stay."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)  # ids only are built
