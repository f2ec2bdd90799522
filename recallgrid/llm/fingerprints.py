"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A fingerprint keeps every shingle hash below a fixed fraction of the hash range, so it grows with the
text, sketches of parts merge by union, and containment of a short text in a long one is estimated as
well as similarity. A text with words whose sketch would be empty keeps its smallest hash, which lies above
the threshold and so tells that it stands alone; merging drops it beside any hash below.

Defined results: null text counts as empty; a text without words has the empty fingerprint, which is
like the empty fingerprint (1) and unlike any other (0); a text of fewer words than a shingle is one
shingle; the next document of a row with a null or repeated doc_id is found by (doc_id nulls first, text);
an only document is its own next; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exact_dedup import LOWER, UPPER

WIDTH = 5
FRACTION = 1 / 4
SPACES = r"[\x20\x09-\x0D]+"


def _limit(fraction: float) -> Column:
    return F.lit(-(1 << 63) + int(fraction * (1 << 64)) - 1)


def _kept(hashes: Column, fraction: float) -> Column:
    """The hashes below the threshold, or the smallest of all."""
    low = F.filter(hashes, lambda x: x <= _limit(fraction))
    return F.when((F.size(low) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(F.array_sort(F.array_distinct(low)))


def sketch(text: Column, fraction: float = FRACTION, width: int = WIDTH) -> Column:
    """Sorted distinct hashes (long) of the shingles that fall below fraction of the hash range."""
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), SPACES, -1), lambda w: w != "")

    def from_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - (width - 1)))
        short = F.array(F.xxhash64(h))
        long = F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + (k - 1)) for k in range(width))))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < width, short).otherwise(long)

    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  value is computed once
    return let(let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes), lambda all_: _kept(all_, fraction))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of two parts together (shingles across the cut apart), equal to that of all their shingles."""
    return _kept(F.array_union(a, b), fraction)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Estimated share of a's shingles that b has; null where a has no hash below the threshold but b has."""
    alone = lambda x: F.get(x, 0) > _limit(fraction)
    unknown = F.coalesce(alone(a) & ~alone(b), F.lit(False))
    return F.when(F.size(a) == 0, F.lit(1.0)).when(~unknown, F.size(F.array_intersect(a, b)) / F.size(a))


def as_string(sketch_: Column) -> Column:
    """16 hex digits a hash."""
    return F.array_join(F.transform(sketch_, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, make: Callable[[Column], Column]) -> DataFrame:
    """doc_id, text, own, next_text and next_own: own is make(text), next_ is of the next row by doc_id, after the last the first.

    Rows are dealt to ranges of doc_id; within a range a window finds the next row, and a range's last
    row takes the first row of the next range that has one. own is made once a row, where its range is.
    """
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    edges = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 10000).alias("edges")).first()["edges"] or []
    edges = sorted(set(edges))  # at most one a range
    place = F.coalesce(F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<bigint>"), lambda e: e < F.col("doc_id"))), F.lit(0)) if edges else F.lit(0)
    placed = rows.withColumn("place", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place))
    order = Window.partitionBy("place").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    first = placed.groupBy("place").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    over = Window.orderBy("place")  # one row a range
    after = first.select(F.col("place").alias("at"), F.coalesce(F.lead("first.text").over(over), F.first("first.text").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    after = after.select("at", F.struct(F.col("after").alias("text"), make(F.col("after")).alias("own")).alias("after"))
    led = placed.repartition("place").withColumn("own", make(F.col("text"))).withColumn("led", F.lead(F.struct("text", "own")).over(order))
    joined = led.join(after.hint("shuffle_hash"), (F.col("place") == F.col("at")) & F.col("led").isNull(), "left").withColumn("next", F.coalesce("led", "after"))
    return joined.select("doc_id", "text", "own", F.col("next.text").alias("next_text"), F.col("next.own").alias("next_own"))


def edited(text: Column, other: Column) -> Column:
    """text with its last quarter (floor of code points) replaced by as many first code points of other."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(other, F.lit(1), quarter))


def fingerprints(docs: DataFrame, fraction: float = FRACTION, width: int = WIDTH) -> DataFrame:
    """Each row's text, its edited text and the next text with the three sketches."""
    make = lambda text: sketch(text, fraction, width)
    rows = with_next(docs, make).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return rows.select("doc_id", "text", "edited", "next_text", F.col("own").alias("own_sketch"), make(F.col("edited")).alias("edited_sketch"), F.col("next_own").alias("next_sketch"))
