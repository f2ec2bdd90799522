"""Files that hold one large JSON array, read in parallel: where its objects begin and end is found by sums over pieces.

Spark's text reader splits a file at closing braces, so each task gets the pieces of its own byte range.
A piece knows how many quotes it has, and how far it nests when it begins outside a string or inside one.
Running sums over a range's pieces, for both cases, and over the ranges of a file then say for each brace
whether it closes an object of the array. No task reads a file whole; a row holds one object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import stored

CLOSING = "}"
ESCAPED = r"(?s)\\."
BEFORE = r"^[\s﻿]*[\[,]\s*"


def _nesting(text: Column) -> Column:
    """Opened minus closed in text that has no strings and no closing brace."""
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return count("{[") - count("]")


def _walked(spark: SparkSession, path: str) -> DataFrame:
    """path, range, nth, value of the pieces, with the sums up to their end: quotes, and depth0 and depth1 for a range that begins outside and inside a string."""
    meta = F.col("_metadata")
    read = spark.read.option("lineSep", CLOSING).text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("range"), F.monotonically_increasing_id().alias("nth"), "value")
    side = lambda k: _nesting(F.array_join(F.filter("parts", lambda _, i: i % 2 == k), ""))
    pieces = read.withColumn("parts", F.split(F.regexp_replace("value", ESCAPED, ""), '"', -1)).withColumns({"n": F.size("parts") - 1, "even": side(0), "odd": side(1)}).drop("parts")
    run = Window.partitionBy("path", "range").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("quotes", F.sum("n").over(run))
    outside = lambda quotes: quotes % 2 == 0
    step = lambda k: F.when(outside(F.col("quotes") - F.col("n") + k), F.col("even")).otherwise(F.col("odd")) - outside(F.col("quotes") + k).cast("int")
    return stored(pieces.select("path", "range", "nth", "value", "quotes", F.sum(step(0)).over(run).alias("depth0"), F.sum(step(1)).over(run).alias("depth1")), "pieces")


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """path, element, value: the text of each object of the files, numbered from 0 in each.

    Each file holds one JSON array of objects (an empty one has no rows); one that doesn't begin as an
    array, or ends before it closes, is a ValueError that names it.
    """
    pieces = _walked(spark, path)
    first = F.substring(F.regexp_replace("value", r"^[\s﻿]+", ""), 1, 1)
    ranges = pieces.groupBy("path", "range").agg(F.max_by(F.struct("quotes", "depth0", "depth1"), "nth").alias("all"), F.min_by(first, "nth").alias("first"))
    earlier = Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("all.quotes").over(earlier), F.lit(0)) % 2)
    ranges = ranges.withColumn("gained", F.when(F.col("inside") == 0, F.col("all.depth0")).otherwise(F.col("all.depth1")))
    ranges = stored(ranges.select("path", "range", "first", "inside", "gained", F.coalesce(F.sum("gained").over(earlier), F.lit(0)).alias("base")), "ranges")
    # behind the array's bracket the reader sees a brace that isn't there: a sound file ends at depth -1
    ends = ranges.groupBy("path").agg(F.max_by(F.col("base") + F.col("gained"), "range").alias("depth"), F.min_by("first", "range").alias("first"))
    damaged = ends.where((F.col("depth") != -1) | (F.col("first") != "[")).select("path").first()
    if damaged:
        raise ValueError(f"not one whole JSON array of objects: {damaged['path']}")
    depth = F.col("base") + F.when(F.col("inside") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    closes = ((F.col("inside") + F.col("quotes")) % 2 == 0) & (depth == 1)
    marked = pieces.join(ranges.select("path", "range", "inside", "base"), ["path", "range"]).select("path", "range", "nth", "value", closes.cast("long").alias("closes"))
    counts = marked.groupBy("path", "range").agg(F.sum("closes").alias("closed")).select("path", "range", F.coalesce(F.sum("closed").over(earlier), F.lit(0)).alias("closed_before"))
    within = Window.partitionBy("path", "range").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    dealt = marked.withColumn("here", F.coalesce(F.sum("closes").over(within), F.lit(0))).join(counts, ["path", "range"])
    objects = dealt.groupBy("path", (F.col("here") + F.col("closed_before")).alias("element")).agg(F.array_sort(F.collect_list(F.struct("range", "nth", "value"))).alias("pieces"), F.max("closes").alias("whole"))
    text = F.concat(F.array_join(F.transform("pieces", lambda p: p["value"]), CLOSING), F.lit(CLOSING))
    return objects.where("whole = 1").select("path", "element", F.regexp_replace(text, BEFORE, "").alias("value"))
