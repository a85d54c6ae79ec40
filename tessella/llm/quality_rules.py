"""Quality rules: base rules on each text, then robust multivariate outliers per language and source.

Each text gives a vector of transformed statistics. Per (language, source) the minimum covariance determinant is sought
over all rows that pass the base rules, COVERAGE of them as the core. Three starts, all from medians and quartiles:
scaled distances, the correlations of hyperbolic tangents, and those of spatial signs. From each, concentration steps keep the COVERAGE of
rows at the least Mahalanobis distance and estimate location and scatter from them; after TRIED steps only the start of
least determinant goes on, until the group's determinant falls no more. Groups that have settled leave the rows of further steps. The core's covariance is multiplied by its consistency factor under the normal
distribution, and a fixed diagonal is added (the squared MARGINS): many statistics are zero in most texts, where the
plain determinant is zero and any text with one digit or one repeated line would be an outlier. A row is rejected if its squared distance
lies beyond the QUANTILE of chi-square. Every step is one grouped aggregation with sums that combine before the shuffle,
so a source with a third of all rows needs no task of its own.

Groups with fewer than MIN_ROWS rows that pass the base rules use the estimate of their language, and languages with
fewer that of all rows.

Cases: null text has no words (rejected by the base rules); null lang or source is a group of its own, apart from the
empty string; repeated rows count each; ties at the core's edge are all in it; a very long text is one row of a task, with
arrays of about 100 times its bytes; an empty table gives an empty result; columns other than doc_id, text, lang and
source are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrays as A
from tessella.llm.store import Scratch, own_columns, row_key, spare_names

SYMBOLS = b"#*$%&|<>"
#: Bytes of texts whose arrays (about 100 times as large) a task holds at once.
SLICE = 1 << 18
MIN_WORDS, REPEAT_PERCENT = 50, 50
MIN_ROWS, STEPS, COVERAGE, QUANTILE = 60, 12, 0.75, 0.9999
#: Statistics and their margins, differences that count as much as one standard deviation in a group without any spread:
#: 0.05 for shares of characters (arcsine root) and for the share of distinct words, twice that for digits, which come in runs, and
#: for word length (a tenth), four times that for shares of lines and windows, which come in whole lines.
MARGINS = {"word_len": 0.1, "upper": 0.05, "symbol": 0.05, "digit": 0.1, "punct": 0.05, "dup_lines": 0.2, "repeat": 0.2, "distinct": 0.05}

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_CLASS = {
    "upper": np.array([65 <= b <= 90 for b in range(256)]),
    "digit": np.array([48 <= b <= 57 for b in range(256)]),
    "punct": np.array([chr(b) in ".,;:!?\"'()-" for b in range(256)]),
}


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_statistics(s: A.Slice) -> dict[str, np.ndarray]:
    """Counts of every row of a slice; code points, words, lines as in the base rules."""
    n = len(s.offsets) - 1
    starts, ends, first = A.word_bounds(s.data, s.offsets)
    sums = A.prefix_sums(s.data)
    words = A.span_hashes(sums, starts, ends)
    lead = (s.data & 0xC0) != 0x80
    out = {
        "n_words": np.diff(first),
        "word_chars": _per_row(lead & ~A.SEPARATOR[s.data], s.offsets),
        "n_symbols": _per_row(_IS_SYMBOL[s.data], s.offsets),
    }
    out |= {k: _per_row(t[s.data], s.offsets) for k, t in _CLASS.items()}
    # lines: between \n and the row's ends; only those with a word count
    cuts = np.flatnonzero(s.data == 10)
    lo = np.sort(np.concatenate([s.offsets[:-1], cuts + 1]))
    hi = np.sort(np.concatenate([cuts, s.offsets[1:]]))
    has = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    lo, hi = lo[has], hi[has]
    row = np.searchsorted(s.offsets, lo, "right") - 1
    line = A.span_hashes(sums, lo, hi) if len(lo) else np.zeros(0, np.uint64)
    out["n_lines"] = np.bincount(row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(_firsts(row, line)[0], minlength=n)
    # words in 3-word windows that occur twice or more in the row
    window, begin = A.shingle_hashes(words, first, 3)
    short = np.diff(first) < 3
    wrow = np.repeat(np.arange(n), np.diff(begin))
    twice = _repeated(wrow, window)
    twice &= ~short[wrow]
    at = first[wrow] + np.arange(len(window)) - begin[wrow]
    mark = np.zeros(len(words) + 3, np.int32)
    np.add.at(mark, at[twice], 1)
    np.add.at(mark, at[twice] + 3, -1)
    covered = np.cumsum(mark)[: len(words)] > 0
    out["n_repeat_words"] = _per_row(covered, first)
    out["n_distinct"] = np.bincount(_firsts(np.repeat(np.arange(n), np.diff(first)), words)[0], minlength=n)
    return out


def _firsts(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return r[new], v[new]


def _repeated(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    same = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    twice = np.zeros(len(r), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(r), bool)
    out[order] = twice
    return out


def vectors(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Transformed statistics: logarithm of the mean word length, arcsine roots of shares (their spread hardly depends on the share)."""
    words, chars, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))

    def root(k: str, of: np.ndarray) -> np.ndarray:
        return np.arcsin(np.sqrt(np.minimum(c[k] / of, 1)))

    # of a text without repetition the share of distinct words falls with the logarithm of its length
    distinct = np.log(np.maximum(c["n_distinct"], 1) / words) / np.log(words + 10)
    x = {"word_len": np.log(chars / words), "upper": root("upper", chars), "symbol": root("n_symbols", chars), "digit": root("digit", chars)}
    return x | {"punct": root("punct", chars), "dup_lines": root("n_dup_lines", lines), "repeat": root("n_repeat_words", words), "distinct": distinct}


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in A.slices(batch, most=SLICE):
            c = text_statistics(s)
            own = [batch.column(i).slice(s.lo, s.hi - s.lo) for i in range(5)]
            yield pa.record_batch(own + [pa.array(c[k].astype(np.int64)) for k in _COUNTS] + [pa.array(v) for v in vectors(c).values()], names=["k1", "k2", "doc_id", "lang", "source", *_COUNTS, *MARGINS])


def chi_square(x: float, p: float) -> float:
    """Distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, y = p / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= y / n
        total += term
    return total * math.exp(-y + a * math.log(y) - math.lgamma(a))


def chi_square_quantile(q: float, p: float) -> float:
    lo, hi = 0.0, 10.0 * p + 100
    for _ in range(200):
        lo, hi = ((lo + hi) / 2, hi) if chi_square((lo + hi) / 2, p) < q else (lo, (lo + hi) / 2)
    return hi


def consistency(coverage: float, p: int) -> float:
    """What the covariance of the core ``coverage`` of a normal distribution is to be multiplied by."""
    return coverage / chi_square(chi_square_quantile(coverage, p), p + 2)


#: Squared distance beyond which a row is an outlier.
CUTOFF = chi_square_quantile(QUANTILE, len(MARGINS))
#: Starts of each group, and steps after which only the one of least determinant goes on.
STARTS, TRIED = 3, 3
#: Up to so many groups their estimates (three starts of 73 doubles each, 7 MB at most) are sent to all tasks; beyond, rows move to them.
SENT_GROUPS = 4096


def _distance(have: list[str]) -> F.Column:
    """Squared Mahalanobis distance from the columns ``loc`` and ``inv`` (row by row, symmetric)."""
    p = len(have)
    d = [F.col(k) - F.col("loc")[i] for i, k in enumerate(have)]
    total = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            total = total + d[i] * d[j] * F.col("inv")[i * p + j] * (1.0 if i == j else 2.0)
    return total


_ESTIMATE = "grp string, start int, loc array<double>, inv array<double>, log_det double"


def _estimates(correlations: bool):
    """Sums of each group and start -> location, inverse scatter and its log-determinant; or inverse correlations about zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, margin, c = len(MARGINS), np.array(list(MARGINS.values())), consistency(COVERAGE, len(MARGINS))
        iu = np.triu_indices(p)
        for t in batches:
            if not t.num_rows:
                continue
            n = t.column("n").to_numpy().astype(float)
            loc = np.array(t.column("s1").to_pylist(), float) / n[:, None]
            second = np.array(t.column("s2").to_pylist(), float) / n[:, None]
            cov = np.zeros((len(n), p, p))
            cov[:, iu[0], iu[1]] = second - loc[:, iu[0]] * loc[:, iu[1]]
            cov = cov + np.swapaxes(cov, 1, 2) - np.einsum("gii->gi", cov)[:, :, None] * np.eye(p)
            if correlations:
                # a tenth of the identity: statistics without any spread stay uncorrelated
                d = np.sqrt(np.einsum("gii->gi", cov) + 1e-12)
                cov, loc = 0.9 * cov / (d[:, :, None] * d[:, None, :]) + 0.1 * np.eye(p), np.zeros_like(loc)
            else:
                cov = c * cov + np.diag(margin**2)
            inv, log_det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
            arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * k), pa.array(x.ravel())) for k, x in ((p, loc), (p * p, inv))]
            yield pa.record_batch([t.column("grp"), t.column("start"), *arrays, pa.array(log_det)], names=["grp", "start", "loc", "inv", "log_det"])

    return run


def _moments(rows: DataFrame) -> DataFrame:
    have = list(MARGINS)
    # shifted by nothing: the statistics are of order one, so plain sums lose no precision
    sums = [F.sum(k).alias(f"a{i}") for i, k in enumerate(have)] + [F.sum(F.col(have[i]) * F.col(have[j])).alias(f"b{i}_{j}") for i in range(len(have)) for j in range(i, len(have))]
    g = rows.groupBy("grp", "start").agg(F.count("*").alias("n"), *sums)
    return g.select("grp", "start", "n", F.array(*[f"a{i}" for i in range(len(have))]).alias("s1"), F.array(*[f"b{i}_{j}" for i in range(len(have)) for j in range(i, len(have))]).alias("s2"))


def least_determinants(work: DataFrame, scratch: Scratch) -> DataFrame:
    """grp, loc, inv, log_det of every group of ``work`` (grp and the statistics)."""
    have = list(MARGINS)
    quartiles = scratch.cut(work.groupBy("grp").agg(*[F.percentile_approx(k, [0.25, 0.5, 0.75], 1000).alias(f"q_{k}") for k in have]), "quartiles")
    small = F.broadcast if quartiles.count() <= SENT_GROUPS else lambda table: table
    spread = lambda: work.withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(STARTS)])))
    # standardised by median and quartiles
    scale = {k: F.sqrt(F.pow((F.col(f"q_{k}")[2] - F.col(f"q_{k}")[0]) / 1.349, 2) + m * m) for k, m in MARGINS.items()}
    z = spread().join(small(quartiles), "grp").select("grp", "start", *have, *[((F.col(k) - F.col(f"q_{k}")[1]) / scale[k]).alias(f"z_{k}") for k in have])
    z = z.withColumn("norm", sum((F.pow(f"z_{k}", 2) for k in have), F.lit(0.0)))
    shaped = z.where("start > 0").select("grp", "start", *[F.when(F.col("start") == 1, F.tanh(f"z_{k}")).otherwise(F.col(f"z_{k}") / F.sqrt(F.col("norm") + 1e-12)).alias(k) for k in have])
    first = scratch.cut(_moments(shaped).mapInArrow(_estimates(True), _ESTIMATE), "starts")
    near = z.join(small(first), ["grp", "start"], "left")
    of_z = near.select("grp", "start", "norm", "loc", "inv", *[F.col(k).alias(f"x_{k}") for k in have], *[F.col(f"z_{k}").alias(k) for k in have])
    near = of_z.withColumn("d2", F.when(F.col("start") == 0, F.col("norm")).otherwise(_distance(have))).select("grp", "start", "d2", *[F.col(f"x_{k}").alias(k) for k in have])
    # est: the last estimates of groups that still move; done: those of groups that have settled
    est, done = None, []
    for step in range(STEPS):
        # a table of its own: its size is known, so the rows need not move to it
        limit = scratch.cut(near.groupBy("grp", "start").agg(F.percentile_approx("d2", COVERAGE, 1000).alias("limit")), "limits")
        core = near.join(small(limit), ["grp", "start"]).where("d2 <= limit")
        now = _moments(core).mapInArrow(_estimates(False), _ESTIMATE)
        if step == TRIED - 1:
            # the other starts have lost
            now = now.groupBy("grp").agg(F.min(F.struct("log_det", "start", "loc", "inv")).alias("b")).select("grp", "b.start", "b.loc", "b.inv", "b.log_det")
        if est is not None:
            now = now.join(small(est.select("grp", "start", F.col("log_det").alias("before"))), ["grp", "start"])
        falls = F.lit(True) if step < TRIED else F.col("before") - F.col("log_det") > 1e-3
        now = scratch.cut(now.withColumn("falls", falls), "scatters")
        if step >= TRIED or step == STEPS - 1:
            done.append(now.where("not falls") if step < STEPS - 1 else now)
        est = now.where("falls")
        if not est.limit(1).count():
            done = done or [now]
            break
        if step < STEPS - 1:
            rows = spread() if step < TRIED - 1 else work
            near = rows.join(small(est), ["grp", "start"] if step < TRIED - 1 else "grp").withColumn("d2", _distance(have))
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d, allowMissingColumns=True)
    return scratch.cut(whole.select("grp", "loc", "inv", "log_det"), "mcd")


def verdicts(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, the base counts, base_failed, distance, kept for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    d = own_columns(docs, "doc_id", "text", "lang", "source")
    keyed = d.select(*row_key(), "doc_id", "lang", "source", "text")
    kinds = f"k1 long, k2 long, doc_id {d.schema['doc_id'].dataType.simpleString()}, lang {d.schema['lang'].dataType.simpleString()}, source {d.schema['source'].dataType.simpleString()}, "
    schema = kinds + ", ".join(f"{k} long" for k in _COUNTS) + ", " + ", ".join(f"{k} double" for k in MARGINS)
    rows = keyed.mapInArrow(_scan, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    lang, source = F.col("lang").cast("string"), F.col("source").cast("string")
    rows = rows.withColumn("base_failed", failed).withColumn("ls", F.to_json(F.array(lang, source))).withColumn("l", F.to_json(F.array(lang)))
    rows = scratch.cut(rows.drop("lang", "source"), "statistics")
    fit = rows.where("not base_failed")
    # a group for each (language, source) with enough rows, otherwise its language, otherwise all
    counts = scratch.cut(fit.groupBy("ls", "l").agg(F.count("*").alias("n_ls")), "counts")
    by_l = counts.groupBy("l").agg(F.sum("n_ls").alias("n_l"))
    grp = F.when(F.col("n_ls") >= MIN_ROWS, F.col("ls")).when(F.col("n_l") >= MIN_ROWS, F.col("l")).otherwise(F.lit("[]"))
    groups = scratch.cut(counts.join(by_l, "l").select("ls", grp.alias("grp")), "groups")
    # an estimate for a language or for all is made from all of its rows, also those that have a group of their own
    needed = groups.select("grp").distinct()
    member = counts.select("ls", F.explode(F.array("ls", "l", F.lit("[]"))).alias("grp")).join(needed, "grp")
    # tables of their own: their size is known when they are joined, and a large group's partition can be split
    member = scratch.cut(member, "members")
    work = scratch.cut(fit.select("ls", *MARGINS).join(member, "ls").drop("ls"), "vectors")
    judged = scratch.cut(groups.join(least_determinants(work, scratch), "grp").select("ls", "loc", "inv"), "judged")
    x = rows.join(judged, "ls", "left").withColumn("distance", _distance(list(MARGINS)))
    return scratch.done(x.select("k1", "k2", "doc_id", *_COUNTS, "base_failed", "distance", (~F.col("base_failed") & ~F.coalesce(F.col("distance") > CUTOFF, F.lit(False))).alias("kept"), *MARGINS))


def result(docs: DataFrame) -> DataFrame:
    return verdicts(docs).select("doc_id", *_COUNTS, "base_failed", "kept", "distance")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and are no outliers."""
    k1, k2 = spare_names(docs, "k1", "k2")
    good = verdicts(docs).where("kept").select(F.col("k1").alias(k1), F.col("k2").alias(k2)).distinct()
    key = row_key()
    return docs.withColumns({k1: key[0], k2: key[1]}).join(good, [k1, k2], "left_semi").drop(k1, k2)
