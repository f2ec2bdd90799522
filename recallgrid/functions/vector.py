"""Dense vectors (array<float>) as Column expressions in double arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; vectors of different lengths are an error."""
    a, b = as_double(a), as_double(b)
    n = norm(a) * norm(b)
    same = F.assert_true(F.size(a) == F.size(b), "vectors of different lengths")
    return F.when(same.isNull(), F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def unit(v: Column) -> Column:
    """v at length 1, null for a zero vector."""
    v = as_double(v)
    # the norm is bound to a lambda's argument, so that it is computed once
    return F.get(F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))), 0)


def pack(v: Column) -> Column:
    """v as little-endian float32 bytes, as embedding services store it; null stays null."""

    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda a: None if a is None else np.asarray(a, dtype="<f4").tobytes())

    return run(v.cast("array<float>"))


def unpack(data: Column) -> Column:
    """array<float> of float32 bytes; null, and bytes that are no whole number of values, give null."""

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4").astype("f4"))

    return run(data)
