"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts is the number of n-grams (1 to 4 bytes of the lower-cased text) that
both contain, divided by the root of the product of their numbers. n-grams are presence bits in BUCKETS hash buckets.
LANDMARKS texts of each language give a Nystroem map of the kernel, and one-versus-rest kernel ridge regression on it
gives a value per language. Texts are scored in batches: bits x landmarks, then x coefficients, two matrix products.

Learned from at most SAMPLE texts of each language, never held-out ones. Text only is an input of a prediction.

Cases: null text or text without a letter is ``und`` with score 0, and so is every text if nothing can be learned;
repeated rows are scored alike; of equal values the first language by name is predicted; ties in the sample go by id; a very long
text is one row of a task, with arrays of about 50 times its bytes; an empty table gives an empty result; columns other than doc_id,
text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrays as A
from tessella.llm.samples import held_out, sample_by_value
from tessella.llm.store import Scratch, own_columns

SAMPLE, LANDMARKS, BUCKETS, LONGEST, RIDGE, ROWS = 400, 24, 1 << 15, 4, 1e-2, 96


def presence(s: A.Slice) -> Iterator[tuple[int, np.ndarray]]:
    """Row within the slice and its presence bits (uint8 of BUCKETS)."""
    data = s.data.astype(np.uint64)
    n = len(data)
    grams, h = [], np.zeros(n, np.uint64)
    for k in range(LONGEST):
        m = n - k
        if m <= 0:
            break
        h = h[:m] * A.U(257) + data[k:] + A.U(1)
        grams.append((((h + A.U(k)) * A.BASE) >> A.U(49)).astype(np.int32))
    for i in range(len(s.offsets) - 1):
        a, b = int(s.offsets[i]), int(s.offsets[i + 1])
        bits = np.zeros(BUCKETS, np.uint8)
        for k, g in enumerate(grams):
            if b - k > a:
                bits[g[a : b - k]] = 1
        yield i, bits


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in A.slices(batch, most=1 << 20):
            bits = [np.packbits(b).tobytes() for _, b in presence(s)]
            yield pa.record_batch([batch.column(i).slice(s.lo, s.hi - s.lo) for i in (0, 1)] + [pa.array(bits, pa.binary())], names=["doc_id", "label", "bits"])


def fit(label: list[str], bits: np.ndarray) -> dict:
    """Landmarks (rows scaled to unit length) and coefficients to each language."""
    names = sorted(set(label))
    if not names:
        return {"names": [], "marks": np.zeros((0, BUCKETS), np.float32), "coef": np.zeros((0, 0), np.float32)}
    x = bits.astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    y = np.array([[float(v == n) for n in names] for v in label])
    chosen = np.concatenate([np.flatnonzero(y[:, i])[:LANDMARKS] for i in range(len(names))])
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = (x @ marks.T).astype(float) @ root
    phi = np.concatenate([phi, np.ones((len(phi), 1))], 1)
    # each language weighs the same, however many texts it has
    weight = (1 / y.sum(0))[y.argmax(1)][:, None]
    b = np.linalg.solve(phi.T @ (phi * weight) + RIDGE * np.eye(phi.shape[1]) / 10, phi.T @ (y * weight))
    return {"names": names, "marks": marks, "coef": (root @ b[:-1]).astype(np.float32), "bias": b[-1].astype(np.float32)}


def train(docs: DataFrame, rows: int = SAMPLE) -> dict:
    d = own_columns(docs, "doc_id", "text", "lang").where(F.col("text").rlike(r"\p{L}"))
    scratch = Scratch(docs.sparkSession)
    got = sample_by_value(d, "lang", rows, scratch).select("doc_id", F.col("label").cast("string"), F.lower("text").alias("text")).mapInArrow(_collect, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, label string, bits binary").toArrow().sort_by("doc_id")
    scratch.drop(*scratch.paths.values())
    bits = [np.unpackbits(np.frombuffer(x, np.uint8)) for x in got.column("bits").to_pylist()]
    return fit(got.column("label").to_pylist(), np.array(bits))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model["names"], "und"], object)
        for batch in batches:
            for s in A.slices(batch, most=1 << 20):
                n = s.hi - s.lo
                best, value = np.full(n, len(names) - 1), np.zeros(n)
                letters = batch.column(2).slice(s.lo, n).to_numpy(zero_copy_only=False).astype(bool)
                if len(names) > 1:
                    x = np.zeros((ROWS, BUCKETS), np.float32)
                    size = np.ones(ROWS, np.float32)
                    for i, bits in presence(s):
                        x[i % ROWS], size[i % ROWS] = bits, max(1, int(bits.sum()))
                        if i % ROWS == ROWS - 1 or i == n - 1:
                            k = i % ROWS + 1
                            out = (x[:k] @ model["marks"].T) / np.sqrt(size[:k, None]) @ model["coef"] + model["bias"]
                            best[i - k + 1 : i + 1], value[i - k + 1 : i + 1] = out.argmax(1), np.clip(out.max(1), 0, 1)
                    best[~letters], value[~letters] = len(names) - 1, 0
                yield pa.record_batch([batch.column(0).slice(s.lo, n), pa.array(names[best].tolist(), pa.string()), pa.array(value)], names=["doc_id", "lang_pred", "score"])

    d = own_columns(docs, "doc_id", "text").select("doc_id", F.lower("text").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def result(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
