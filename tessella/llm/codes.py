"""Product codes of vectors: codebooks of integer parts, nearest entries found by annular norm pruning.

Vectors become integers and are cut into equal parts; every part position has a codebook. An entry at distance d of a part has a
norm at most d from the part's (triangle inequality). So entries are sorted by norm, the entries nearest in norm give a first distance, two binary searches give
the interval of norms that it allows, and exactly these entries are evaluated, the ends included. Rounds of the codebooks add up sums per entry in every task first;
what reaches the driver is one codebook, whatever the number of vectors. Vectors are never shuffled.

Cases: null vectors and those with null, non-finite or overlarge (beyond 2**22 after scaling) components are dropped; shorter vectors count as ended with zeros, the
length being the longest vector's rounded up to a multiple of the parts; fewer vectors than entries give a smaller codebook; a vec_id with several
vectors seeds one entry, the least of them; a null vec_id is coded but seeds none; repeated rows count as often as they stand there and each get a row; an empty table
gives an empty result; without any vec_id all entries are missing and the result is empty too; columns other than vec_id, embedding and label are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import vectors as V
from tessella.llm.store import Scratch, own_columns

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Entries nearest in norm that give the first distance.
FIRST = 4


class Annuli:
    """One codebook sorted by norm; ``nearest`` returns index and squared distance of the nearest entry (ties: lower index)."""

    def __init__(self, entries: np.ndarray):
        norms = np.sqrt((entries * entries).sum(1))
        self.index = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.index], entries[self.index]
        self.evaluated = 0

    def _keys(self, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distance and index in one integer, so that the least one decides ties as well."""
        d = x[row] - self.entries[at]
        self.evaluated += len(row)
        return (d * d).sum(1) * len(self.index) + self.index[at]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = len(x), len(self.index)
        rows, r = np.arange(n), np.sqrt((x * x).sum(1))
        at = np.searchsorted(self.norms, r) - FIRST // 2
        best = np.min([self._keys(x, rows, np.clip(at + i, 0, m - 1)) for i in range(FIRST)], axis=0)
        reach = np.sqrt(best // m) * (1 + 1e-12) + r * 1e-12
        lo, hi = np.searchsorted(self.norms, r - reach, "left"), np.searchsorted(self.norms, r + reach, "right")
        many = np.maximum(hi - lo, 0)
        row = np.repeat(rows, many)
        keys = self._keys(x, row, np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(len(row)))
        np.minimum.at(best, row, keys)
        return best % m, best // m


def parts(x: np.ndarray, n: int) -> np.ndarray:
    """(rows, dim) to (n, rows, dim / n)."""
    return np.ascontiguousarray(x.reshape(len(x), n, x.shape[1] // n).transpose(1, 0, 2))


def assign(books: list[Annuli], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (rows, parts) and squared distances (rows, parts)."""
    found = [b.nearest(p) for b, p in zip(books, parts(x, len(books)))]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def seeds(kept: DataFrame, dim: int) -> np.ndarray:
    """Vectors of the ENTRIES smallest ids, ascending. Every task keeps its smallest ids only."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(0, np.int64)
        for batch in batches:
            have = np.unique(np.concatenate([have, batch.column(0).drop_null().to_numpy()]))[:ENTRIES]
        yield pa.record_batch([pa.array(have)], names=["vec_id"])

    ids = [r[0] for r in kept.select(F.col("vec_id").try_cast("long").alias("vec_id")).mapInArrow(smallest, "vec_id long").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    found = kept.where(F.col("vec_id").try_cast("long").isin(ids)).groupBy(F.col("vec_id").try_cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding")).orderBy("vec_id").collect() if ids else []
    return V.matrix(pa.array([r.embedding for r in found], pa.list_(pa.float64())), SCALE, dim)


def improved(kept: DataFrame, books: np.ndarray, dim: int) -> np.ndarray:
    """Every entry as the floored mean of the parts nearest to it; entries without any stay."""
    n, m, w = books.shape

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books]
        sums, count = np.zeros((n * m, w), np.int64), np.zeros(n * m, np.int64)
        for batch in (r for b in batches for r in V.runs(b)):
            x = V.matrix(batch.column(0), SCALE, dim)
            at = (assign(annuli, x)[0] + np.arange(n) * m).T.ravel()
            np.add.at(sums, at, parts(x, n).reshape(-1, w))
            count += np.bincount(at, minlength=n * m)
        used = np.flatnonzero(count)
        yield pa.record_batch([pa.array(np.repeat(used, w)), pa.array(np.tile(np.arange(w), len(used))), pa.array(sums[used].ravel()), pa.array(np.repeat(count[used], w))], names=["entry", "place", "total", "count"])

    found = kept.select("embedding").mapInArrow(totals, "entry long, place long, total long, count long").groupBy("entry", "place").agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
    out = books.reshape(n * m, w).copy()
    for r in found.collect():
        out[r.entry, r.place] = r.total // r["count"]
    return out.reshape(n, m, w)


def learn(kept: DataFrame) -> np.ndarray:
    """Codebooks (parts, entries, width) of usable vectors."""
    dim = V.width(kept, "embedding", PARTS)
    books = parts(seeds(kept, dim), PARTS)
    for _ in range(ROUNDS if books.shape[1] else 0):
        books = improved(kept, books, dim)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """Columns of ``kept`` but the vector, with code and error."""
    n, m, w = books.shape
    other = [f for f in kept.schema.fields if f.name != "embedding"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = [Annuli(b) for b in books]
        for batch in (r for b in batches for r in V.runs(b)):
            at, error = assign(annuli, V.matrix(batch.column(0), SCALE, n * w))
            text = at.astype(np.uint8).tobytes().hex()
            code = [text[i : i + 2 * n] for i in range(0, len(text), 2 * n)]
            yield pa.record_batch([*batch.columns[1:], pa.array(code, pa.string()), pa.array(error.sum(1))], names=[*batch.schema.names[1:], "code", "error"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in other], "code string, error long"])
    return kept.select("embedding", *[f.name for f in other]).mapInArrow(coded, schema)


def result(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, summed error of the label, and digest of the codebooks, of every usable vector."""
    scratch = Scratch(embeddings.sparkSession)
    kept = own_columns(embeddings, "vec_id", "embedding", "label").where(V.usable("embedding", SCALE))
    books = learn(kept)
    if not books.shape[1]:
        kept, books = kept.where("false"), np.zeros((PARTS, 1, 1), np.int64)
    made = scratch.cut(encode(kept, books), "codes")
    # one row per label on the small side, so rows of a frequent label can be split
    by_label = made.groupBy(F.col("label").alias("same")).agg(F.sum("error").alias("label_error"))
    return scratch.done(made.join(by_label, F.col("label").eqNullSafe(F.col("same"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), "codes")
