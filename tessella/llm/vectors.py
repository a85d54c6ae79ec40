"""Integer vectors from a column of float arrays, shared by search and compression of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components beyond this (after scaling) take no part: sums of squares of theirs would not be exact any more.
LIMIT = 1 << 22


def usable(vector: str, scale: int) -> Column:
    """True for a vector without null, NaN, infinite or overlarge components; null for others or false."""
    return F.forall(F.col(vector), lambda x: F.abs(x * F.lit(float(scale))) < F.lit(float(LIMIT)))


def width(kept: DataFrame, vector: str, multiple: int = 1) -> int:
    """Components of the longest vector, rounded up to a multiple, which is the least."""
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    return max(1, -(-longest // multiple)) * multiple


def matrix(column: pa.Array, scale: int, dim: int) -> np.ndarray:
    """floor(scale * x) as one row per vector; missing trailing components are 0. Only for usable vectors."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    n, lengths = len(column), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    whole = np.floor(values * scale).astype(np.int64)
    if n and (lengths == dim).all():
        return whole.reshape(n, dim)
    out = np.zeros((n, dim), np.int64)
    begin = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(n), lengths), np.arange(len(whole)) - np.repeat(begin, lengths)] = whole
    return out


def runs(batch: pa.RecordBatch, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)
