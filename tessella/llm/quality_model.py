"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)**2 - sum (v_if x_i)**2)): all pairwise interactions of rank
RANK in time linear in the number of non-zero inputs. Inputs are words hashed into BUCKETS (unit length per text), the
structure statistics of the quality rules, and lengths (bytes, words, lines); never label, language, source or id.

Fitted on at most SAMPLE labelled rows that are not held out. Without labelled rows every score is 0.5, with rows of
one kind that kind's share.

Cases: null or empty text has only the structure of an empty text and is scored from it; repeated rows are scored alike, of
several labels of one doc_id the highest counts; a null label is no label; ties in the sample go by id; a very long text is one row of a task,
with arrays of about 100 times its bytes; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm import arrays as A
from tessella.llm.quality_rules import text_statistics, vectors
from tessella.llm.samples import held_out, sample
from tessella.llm.store import own_columns

SAMPLE, BUCKETS, RANK, EPOCHS, BATCH, THRESHOLD = 6000, 1 << 15, 8, 6, 64, 0.3
#: Least number of steps: small samples are gone through more often than EPOCHS times.
STEPS = 600


def inputs(s: A.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of the hashed words, and the dense inputs (rows x D)."""
    c = text_statistics(s)
    dense = list(vectors(c).values()) + [np.log1p(np.diff(s.offsets)), np.log1p(c["n_words"]), np.log1p(c["n_lines"])]
    data = A.LOWER[s.data]
    starts, ends, first = A.word_bounds(data, s.offsets)
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    key = (row << 15) | (A.span_hashes(A.prefix_sums(data), starts, ends) & A.U(BUCKETS - 1)).astype(np.int64)
    key.sort()
    at = np.flatnonzero(np.diff(key, prepend=-1))
    count = np.log1p(np.diff(np.append(at, len(key))))
    row, bucket = key[at] >> 15, key[at] & (BUCKETS - 1)
    norm = np.sqrt(np.bincount(row, count * count, n))
    return row, bucket, count / norm[row], np.stack(dense, 1)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in A.slices(batch):
            row, bucket, value, dense = inputs(s)
            cut = np.searchsorted(row, np.arange(s.hi - s.lo + 1))
            parts = [[x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])] for x in (bucket.astype(np.uint16), value.astype(np.float32))]
            label = batch.column(batch.schema.get_field_index("label")).slice(s.lo, s.hi - s.lo)
            yield pa.record_batch([label, *[pa.array(x, pa.binary()) for x in parts], pa.array([x.astype(np.float32).tobytes() for x in dense], pa.binary())], names=["label", "b", "v", "d"])


def _raw(m: dict, row: np.ndarray, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, and the sums over inputs of v x (rows x RANK)."""
    n = len(dense)
    z = np.clip((dense - m["mean"]) / m["scale"], -8, 8)
    linear = np.bincount(row, m["w"][bucket] * value, n) + z @ m["wd"]
    vx = m["v"][bucket] * value[:, None]
    sums = np.stack([np.bincount(row, vx[:, f], n) for f in range(RANK)], 1) + z @ m["vd"]
    squares = np.bincount(row, (vx * vx).sum(1), n) + (z * z) @ (m["vd"] ** 2).sum(1)
    return m["w0"] + linear + 0.5 * ((sums * sums).sum(1) - squares), sums


def fit(label: np.ndarray, buckets: list[np.ndarray], values: list[np.ndarray], dense: np.ndarray) -> dict:
    """Adagrad on mini-batches in a fixed order."""
    d = dense.shape[1] if dense.ndim == 2 else 0
    rng = np.random.default_rng(5)
    m = {"w0": 0.0, "w": np.zeros(BUCKETS), "v": rng.normal(0, 0.02, (BUCKETS, RANK)), "wd": np.zeros(d), "vd": rng.normal(0, 0.02, (d, RANK)), "mean": np.zeros(d), "scale": np.ones(d)}
    if not len(label):
        return m
    rate = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    m["w0"] = float(np.log(rate / (1 - rate)))
    m["mean"], m["scale"] = dense.mean(0), dense.std(0) + 0.05
    if label.min() == label.max():
        m["v"] *= 0
        m["vd"] *= 0
        return m
    gw, gv, gwd, gvd, g0 = (np.full_like(m[k], 1e-2) for k in ("w", "v", "wd", "vd", "mean"))
    g0 = 1e-2
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(label)))):
        order = rng.permutation(len(label))
        for lo in range(0, len(order), BATCH):
            ids = order[lo : lo + BATCH]
            row = np.repeat(np.arange(len(ids)), [len(buckets[i]) for i in ids])
            b, x = np.concatenate([buckets[i] for i in ids]).astype(np.int64), np.concatenate([values[i] for i in ids]).astype(float)
            dn = dense[ids]
            raw, sums = _raw(m, row, b, x, dn)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[ids]) / len(ids)
            z = np.clip((dn - m["mean"]) / m["scale"], -8, 8)
            g_w = np.bincount(b, err[row] * x, BUCKETS)
            own = m["v"][b] * (x * x)[:, None]
            g_each = err[row][:, None] * (sums[row] * x[:, None] - own)
            hit = np.unique(b)
            g_v = np.stack([np.bincount(b, g_each[:, f], BUCKETS)[hit] for f in range(RANK)], 1) + 1e-5 * m["v"][hit]
            g_wd = z.T @ err + 1e-4 * m["wd"]
            g_vd = z.T @ (err[:, None] * sums) - m["vd"] * ((z * z).T @ err)[:, None] + 1e-4 * m["vd"]
            gw[hit] += g_w[hit] ** 2
            gv[hit] += g_v**2
            gwd += g_wd**2
            gvd += g_vd**2
            g0 += float(err.sum()) ** 2
            m["w"][hit] -= 0.1 * g_w[hit] / np.sqrt(gw[hit])
            m["v"][hit] -= 0.05 * g_v / np.sqrt(gv[hit])
            m["wd"] -= 0.1 * g_wd / np.sqrt(gwd)
            m["vd"] -= 0.05 * g_vd / np.sqrt(gvd)
            m["w0"] -= 0.1 * float(err.sum()) / np.sqrt(g0)
    return m


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> dict:
    got = sample(own_columns(docs, "doc_id", "text"), labels, "quality", rows).select("label", "text").mapInArrow(_collect, "label int, b binary, v binary, d binary").toArrow()
    read = lambda c, t: [np.frombuffer(x, t) for x in got.column(c).to_pylist()]
    dense = np.array(read("d", np.float32), float)
    return fit((np.array(got.column("label").to_pylist(), float) > 0).astype(float), read("b", np.uint16), read("v", np.float32), dense)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score."""
    if not len(model["wd"]):
        model = model | {"wd": np.zeros(11), "vd": np.zeros((11, RANK)), "mean": np.zeros(11), "scale": np.ones(11), "v": model["v"] * 0}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in A.slices(batch):
                raw, _ = _raw(model, *inputs(s))
                yield pa.record_batch([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], names=["doc_id", "score"])

    d = own_columns(docs, "doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")


def result(docs: DataFrame, labels: DataFrame) -> DataFrame:
    x = score(docs, train(docs, labels))
    return x.select("doc_id", held_out().alias("held_out"), "score", (x.score >= THRESHOLD).cast("int").alias("predicted"))
