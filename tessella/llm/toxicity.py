"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - theta_k) with one weight vector for all ordered thresholds theta_1 <= ... <= theta_K.
Features are words (lower-cased, outer punctuation stripped) and word beginnings of 4 and 6 bytes, valued 1 + log(count).
Only features of at least MIN_DF sampled documents, and telling by LEAST_Z standard errors, get a weight; they are kept by their 64-bit hash, so an unknown word
never shares one. The labels say toxic or not; severity grades among the toxic rows are thirds of the amount of words
that the sample's toxic documents use far more often. Output is the expected grade and its share of the highest grade.

The model is fitted on at most SAMPLE labelled rows that are not held out. Without labelled rows of both kinds every
score is the share of toxic labels (0 without any).

The output says so too: the column ``grades`` names what each grade was learned from.

Cases: null or empty text has no features and gets the base rate; repeated rows are scored alike, of several labels of one doc_id the
highest counts; a null label is no label; ties in the sample go by id; a very long text is one row of a task, with arrays of
about 100 times its bytes; an empty table gives an empty result, empty labels the base rate 0; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrays as A
from tessella.llm.samples import held_out, sample
from tessella.llm.store import own_columns

SAMPLE, MIN_DF, GRADES, PREFIXES = 8000, 4, 3, (4, 6)
STEPS, L1, LEAST_Z = 4000, 1e-5, 4.0
#: A document is called toxic from this probability of any grade above 0 on.
DECIDE = 0.2
LEARNED = "grade > 0: labels.toxic; grades 1-3: thirds of the amount of telling words among toxic sample rows"

_INNER = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])


def occurrences(s: A.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every word and of its beginnings, in no order."""
    data = A.LOWER[s.data]
    starts, ends, first = A.word_bounds(data, s.offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(_INNER[data])])
    inner = np.flatnonzero(_INNER[data])
    some = at[ends] > at[starts]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[some]
    lo, hi = inner[at[starts[some]]], inner[at[ends[some]] - 1] + 1
    sums = A.prefix_sums(data)
    rows, hashes = [row], [A.span_hashes(sums, lo, hi)]
    for k in PREFIXES:
        long = hi - lo > k
        rows.append(row[long])
        hashes.append(A.mix(A.span_hashes(sums, lo[long], lo[long] + k) + A.U(k)))
    return np.concatenate(rows), np.concatenate(hashes)


def counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature hash and count, sorted by row and hash."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return row[at], h[at], np.diff(np.append(at, len(h)))


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in A.slices(batch):
            row, h, n = counted(*occurrences(s))
            cut = np.searchsorted(row, np.arange(s.hi - s.lo + 1))
            yield pa.record_batch(
                [batch.column(batch.schema.get_field_index("label")).slice(s.lo, s.hi - s.lo)]
                + [pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()) for x in (h, n.astype(np.uint32))],
                names=["label", "h", "n"],
            )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(label: np.ndarray, hashes: list[np.ndarray], counts: list[np.ndarray]) -> dict:
    """Weights by feature hash, and thresholds."""
    rate = float(label.mean()) if len(label) else 0.0
    empty = {"h": np.zeros(0, np.uint64), "w": np.zeros(0), "theta": np.full(GRADES, np.log((1 - rate + 1e-6) / (rate + 1e-6)))}
    if not len(label) or rate in (0.0, 1.0):
        return empty
    flat = np.concatenate(hashes)
    known, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(label)), [len(x) for x in hashes])
    # sparse from the start: only features whose share among toxic rows is higher by LEAST_Z standard errors
    n1, n0 = label.sum(), (1 - label).sum()
    d1 = np.bincount(column, label[row], len(known))
    share = df / len(label)
    z = (d1 / n1 - (df - d1) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0) + 1e-12)
    good = (df >= MIN_DF) & (z >= LEAST_Z)
    keep = good[column]
    known, renumber = known[good], np.cumsum(good) - 1
    if not len(known):
        return empty
    row, column, count = row[keep], renumber[column[keep]], np.concatenate(counts)[keep].astype(float)
    value = 1 + np.log(count)
    bad = np.bincount(column, label[row], len(known)) + 0.1
    fine = np.bincount(column, 1 - label[row], len(known)) + 0.1
    telling = (bad / label.sum()) / (fine / (1 - label).sum()) > 20
    amount = np.bincount(row, value * telling[column], len(label))
    edges = np.quantile(amount[label == 1], np.arange(1, GRADES) / GRADES)
    grade = np.where(label == 1, 1 + np.searchsorted(edges, amount, "right"), 0)
    above = (grade[:, None] > np.arange(GRADES)[None, :]).astype(float)
    # the model is a product of binary choices only through adjacent thresholds: P(grade = k) = P(> k - 1) - P(> k)
    w = np.zeros(len(known))
    share = above.mean(0)
    theta = np.log((1 - share + 1e-4) / (share + 1e-4))
    theta = np.maximum.accumulate(theta + np.arange(GRADES) * 1e-3)
    gw, gt = np.full(len(w), 1e-8), np.full(GRADES, 1e-8)
    n = len(label)
    for _ in range(STEPS):
        eta = np.bincount(row, value * w[column], n)
        p = np.concatenate([np.ones((n, 1)), _sigmoid(eta[:, None] - theta[None, :]), np.zeros((n, 1))], 1)
        slope = p * (1 - p)
        i = np.arange(n)
        q = np.maximum(p[i, grade] - p[i, grade + 1], 1e-9)
        d_eta = -(slope[i, grade] - slope[i, grade + 1]) / q / n
        g = np.bincount(column, value * d_eta[row], len(w))
        d_theta = np.zeros(GRADES)
        upper, lower = grade < GRADES, grade > 0
        np.add.at(d_theta, grade[upper], (-slope[i, grade + 1] / q / n)[upper])
        np.add.at(d_theta, grade[lower] - 1, (slope[i, grade] / q / n)[lower])
        gw += g * g
        gt += d_theta * d_theta
        step = 0.6 / np.sqrt(gw)
        w = np.maximum(w - step * (g + L1), 0)  # more evidence never lowers the severity
        theta = np.maximum.accumulate(theta - 0.1 / np.sqrt(gt) * d_theta)
    used = w != 0
    table = np.zeros(1 << 20, bool)
    table[(known[used] >> A.U(44)).astype(np.int64)] = True
    return {"h": known[used], "w": w[used], "theta": theta, "table": table}


def expected(model: dict, s: A.Slice) -> np.ndarray:
    """P(grade > k) for each row and k."""
    eta = np.zeros(s.hi - s.lo)
    if len(model["h"]):
        row, h = occurrences(s)
        # most words have no weight: a table of the hashes' first bits tells before any search
        maybe = model["table"][(h >> A.U(44)).astype(np.int64)]
        row, h = row[maybe], h[maybe]
        at = np.minimum(np.searchsorted(model["h"], h), len(model["h"]) - 1)
        hit = model["h"][at] == h
        row, h, n = counted(row[hit], h[hit])
        eta = np.bincount(row, (1 + np.log(n)) * model["w"][np.searchsorted(model["h"], h)], s.hi - s.lo)
    return _sigmoid(eta[:, None] - model["theta"][None, :])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> dict:
    got = sample(own_columns(docs, "doc_id", "text"), labels, "toxic", rows).select("label", "text").mapInArrow(_collect, "label int, h binary, n binary").toArrow()
    label = np.array(got.column("label").to_pylist(), float)
    return fit((label > 0).astype(float), [np.frombuffer(x, np.uint64) for x in got.column("h").to_pylist()], [np.frombuffer(x, np.uint32) for x in got.column("n").to_pylist()])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, severity (0 to GRADES), score (its share, 0 to 1), toxic (1 if P(grade > 0) >= DECIDE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in A.slices(batch):
                p = expected(model, s)
                yield pa.record_batch([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array((p[:, 0] >= DECIDE).astype(np.int32))], names=["doc_id", "severity", "score", "toxic"])

    d = own_columns(docs, "doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, severity double, score double, toxic int")


def result(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "severity", "score", F.col("toxic").alias("predicted"), F.lit(LEARNED).alias("grades"))
