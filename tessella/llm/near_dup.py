"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct 5-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; fewer words: the
whole sequence as one shingle; none: an empty set, linked with nothing). For each of m registers the least
exponential hash of the set is kept on an exponential scale, truncated to ``[0, q + 1]`` (SetSketch, b = 1.001):
``K = floor(1 - log_b(min))``. Registers merge by their maximum and collide about as often as sets overlap.

1. Equal sets become one class before anything is joined (grouped by a 128-bit sum of the shingles).
2. Bands of registers give bucket keys. A bucket is never expanded into all pairs: each class is paired with the
   bucket's centre (least class by a hash), found by a grouped minimum and joined back, a join that can be split.
3. Pairs get the joint maximum-likelihood Jaccard of their registers; only those within ``margin`` of the threshold,
   or above it, go on.
4. Links are confirmed on the full sets, recomputed from the texts.
5. Buckets that still hold several components are worked through completely: every member outside the largest
   component of the bucket against every member of another component. Small buckets by pairs; of large ones blocks of the
   former against blocks of all, on the full sets, each task on a bounded number of members and returning a forest of
   confirmed links, not all pairs.

Cases: null text is an empty text; rows that share a doc_id are one document: it has each of their sets, and is linked
with whatever one of them is (n_shingles is the row's own); repeated rows are one row of it; a null doc_id is numbered by
its text, and its component_id is null unless it is linked to a numbered row; ties among centres go by id; a very long text
is one row of a task, with arrays of about 100 times its bytes; an empty table gives an empty result; ids that are no whole numbers
are named by 62 bits of a hash (two of 100 million share one with probability 0.001); columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessella.llm import arrays as A
from tessella.llm.store import Scratch, components, own_columns, spare_names

#: Registers: BANDS bands of ROWS. A pair of similarity 0.85 misses all bands with probability (1 - 0.85**5)**32 = 7e-9.
BANDS, ROWS, B, RATE, Q = 32, 5, 1.001, 20.0, 2**16 - 2
SHINGLE = 5
#: Buckets of up to SMALL members are worked through as pairs, larger ones in blocks of about BLOCK.
SMALL, BLOCK = 64, 384
#: Ids above this stand for rows without doc_id, above the second for further sets of one doc_id.
NO_ID = 1 << 62
MORE_SETS = NO_ID + (1 << 61)
_MULT = A.seeds(BANDS * ROWS, 7)


def document_sets(s: A.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row of a slice, sorted within the row, and where each row begins."""
    data = A.LOWER[s.data]
    starts, ends, first = A.word_bounds(data, s.offsets)
    h, begin = A.shingle_hashes(A.span_hashes(A.prefix_sums(data), starts, ends), first, SHINGLE)
    for i in range(len(begin) - 1):
        h[begin[i] : begin[i + 1]].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[begin[:-1][np.diff(begin) > 0]] = True
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[begin]


def sketch(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """SetSketch registers (rows x m, uint16) of the sets in ``values``; an empty set has only zeros."""
    out = np.zeros((len(begin) - 1, BANDS * ROWS), np.uint16)
    rows = np.flatnonzero(np.diff(begin))
    if not len(rows):
        return out
    low = np.empty((len(rows), BANDS * ROWS), np.float64)
    work = np.empty(len(values), np.uint64)
    for j, a in enumerate(_MULT):
        np.multiply(values, a, out=work)
        low[:, j] = np.minimum.reduceat(work, begin[rows])
    h = -np.log1p(-(low + 1024.0) / (2.0**64 + 4096.0)) / RATE
    out[rows] = np.clip(np.floor(1 - np.log(h) / np.log(B)), 0, Q + 1).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    key = np.zeros((len(registers), BANDS), np.uint64) + A.seeds(BANDS, 11)
    for r in range(ROWS):
        key = A.mix(key ^ (registers[:, r::ROWS][:, :BANDS].astype(np.uint64) + A.U(1)) * A.BASE)
    return key.view(np.int64)


def likely_jaccard(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard of pairs of sketches (rows x m) given the set sizes, by golden section."""
    more, less = (ka > kb).sum(1), (ka < kb).sum(1)
    same = ka.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    log_b = np.log(B)

    def chance(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-x * (B - 1) / B) / log_b, 1e-12)

    def score(j: np.ndarray) -> np.ndarray:
        p, q = chance(np.maximum(u - v * j, 0)), chance(np.maximum(v - u * j, 0))
        return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    g = (np.sqrt(5) - 1) / 2
    for _ in range(24):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        left = score(a) > score(b)
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return (lo + hi) / 2


_SETS = "node long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>, regs binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for s in A.slices(batch):
            h, begin = document_sets(s)
            n = np.diff(begin)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(A.mix(h ^ c))]) for c in A.seeds(2, 3)]
            sums = [(x[begin[1:]] - x[begin[:-1]]).view(np.int64) for x in sums]
            regs = sketch(h, begin)
            keys = band_keys(regs)
            full = n > 0
            at = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
            yield pa.record_batch(
                [ids.slice(s.lo, s.hi - s.lo), batch.column(1).slice(s.lo, s.hi - s.lo), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[full].ravel())), pa.array([x.tobytes() for x in regs], pa.binary())],
                names=["node", "text_hash", "n_shingles", "s1", "s2", "bands", "regs"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in A.slices(batch):
            h, begin = document_sets(s)
            yield pa.record_batch([batch.column(0).slice(s.lo, s.hi - s.lo), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(h.view(np.int64)))], names=["node", "items"])


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        if t.num_rows:
            ra, rb = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint16).reshape(t.num_rows, -1) for c in ("ra", "rb"))
            est = likely_jaccard(ra, rb, t.column("na").to_numpy().astype(float), t.column("nb").to_numpy().astype(float))
            yield pa.record_batch([t.column("a"), t.column("b"), pa.array(est)], names=["a", "b", "est"])


def whole_ids(docs: DataFrame) -> bool:
    """Whether the table's ids are whole numbers, which name their nodes; others are named by 62 bits of a hash."""
    return "doc_id" not in {c.lower() for c in docs.columns} or isinstance(docs.schema[next(c for c in docs.columns if c.lower() == "doc_id")].dataType, IntegralType)


def node_column(docs: DataFrame) -> F.Column:
    """The doc_id as a number, or for a null one an id above NO_ID from the text."""
    own = F.col("doc_id").cast("long") if whole_ids(docs) else F.when(F.col("doc_id").isNotNull(), F.shiftrightunsigned(F.xxhash64(F.lit(9), "doc_id"), 2))
    return F.coalesce(own, F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 3))


def numbered(docs: DataFrame) -> DataFrame:
    """(node, text) of every row."""
    d = own_columns(docs, "doc_id", "text")
    return d.select(node_column(docs).alias("node"), "text")


def with_ids(x: DataFrame, docs: DataFrame, node: str, group: str) -> DataFrame:
    """``x`` with ``doc_id`` of its ``node`` and ``least_id``, the least doc_id of its ``group``, in the table's own type; null where there is none."""
    if whole_ids(docs):
        kind = docs.schema["doc_id"].dataType.simpleString() if "doc_id" in docs.columns else "long"
        known = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).cast(kind)
        return x.withColumns({"doc_id": known(node), "least_id": known(group)})
    ids = own_columns(docs, "doc_id", "text").where("doc_id is not null").select(node_column(docs).alias(node), "doc_id").distinct()
    x = x.join(ids, node, "left")
    return x.join(x.groupBy(group).agg(F.min("doc_id").alias("least_id")), group)


class _Pairs:
    """Estimates and exact checks of pairs of classes."""

    def __init__(self, texts: DataFrame, classes: DataFrame, percent: int, margin: float, scratch: Scratch):
        self.texts, self.classes, self.percent, self.margin, self.scratch = texts, classes, percent, margin, scratch

    def likely(self, pairs: DataFrame) -> DataFrame:
        c = self.classes
        x = pairs.join(c.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ra")), "a")
        x = x.join(c.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("rb")), "b")
        # sizes alone rule a pair out: the overlap is at most the smaller set, the union at least the larger
        x = x.where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        return x.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_estimates, "a long, b long, est double").where(F.col("est") >= self.percent / 100 - self.margin)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets meet the threshold."""
        need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        # a node has one set, however many rows
        own = self.texts.join(need, "node").mapInArrow(_full_sets, "node long, items array<long>").dropDuplicates(["node"])
        sets = self.scratch.cut(own, "sets")
        x = pairs.join(sets.withColumnsRenamed({"node": "a", "items": "ia"}), "a").join(sets.withColumnsRenamed({"node": "b", "items": "ib"}), "b")
        x = x.withColumn("both", F.size(F.array_intersect("ia", "ib")).cast("long"))
        return x.where(100 * F.col("both") >= self.percent * (F.size("ia") + F.size("ib") - F.col("both"))).select("a", "b")


def _block(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links of the odd members of a block with the others, exact, as a forest over the components so far."""
        t = table.combine_chunks()
        items = t.column("items").combine_chunks() if isinstance(t.column("items"), pa.ChunkedArray) else t.column("items")
        node, comp = (t.column(c).to_numpy() for c in ("node", "comp"))
        as_odd = t.column("as_odd").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(as_odd), np.flatnonzero(~as_odd)
        sizes = np.diff(items.offsets.to_numpy())
        flat = items.flatten().to_numpy()
        owner = np.repeat(np.arange(len(node)), sizes)
        _, col, df = np.unique(flat, return_inverse=True, return_counts=True)
        keep = df[col] > 1  # what only one document has never counts in an overlap
        owner, col = owner[keep], np.unique(col[keep], return_inverse=True)[1]
        both = np.zeros((len(left), len(right)), np.float32)
        order = np.argsort(col, kind="stable")
        owner, col = owner[order], col[order]
        for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 8192):
            a, b = np.searchsorted(col, [lo, lo + 8192])
            m = np.zeros((len(node), min(8192, int(col[-1]) + 1 - lo)), np.float32)
            m[owner[a:b], col[a:b] - lo] = 1
            both += m[left] @ m[right].T
        union = sizes[left][:, None] + sizes[right][None, :] - both
        linked = 100 * both >= percent * union
        out = []
        comp = comp.copy()
        for i, row in zip(left.tolist(), linked):
            js = right[row]
            for j in js[comp[js] != comp[i]].tolist():
                if comp[j] != comp[i]:
                    comp[comp == comp[j]] = comp[i]
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _in_blocks(left: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links of the members of large buckets outside their largest component with all others, block against block of BLOCK members, on the full sets."""
    sets = texts.join(left.select("node").distinct(), "node").mapInArrow(_full_sets, "node long, items array<long>").dropDuplicates(["node"])
    odd = left.where("comp != main").groupBy("key").agg(F.count("*").alias("n_odd"))
    x = left.join(odd, "key").join(sets, "node").withColumn("ni", F.ceil(F.col("n_odd") / BLOCK).cast("int")).withColumn("nj", F.ceil(F.col("n") / BLOCK).cast("int"))
    spread = F.xxhash64("node")
    others = x.withColumn("j", F.pmod(spread, F.col("nj")).cast("int")).withColumn("i", F.explode(F.expr("sequence(0, ni - 1)"))).withColumn("as_odd", F.lit(False))
    odds = x.where("comp != main").withColumn("i", F.pmod(spread, F.col("ni")).cast("int")).withColumn("j", F.explode(F.expr("sequence(0, nj - 1)"))).withColumn("as_odd", F.lit(True))
    cols = ["key", "i", "j", "as_odd", "node", "comp", "items"]
    return others.select(*cols).union(odds.select(*cols)).groupBy("key", "i", "j").applyInArrow(_block(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, margin: float = 0.17) -> DataFrame:
    """node, n_shingles, component per row of ``docs`` (see the module's text).

    ``margin``: how far below the threshold an estimate from 160 registers may lie (six standard errors) and still be checked.
    """
    s, texts = Scratch(docs.sparkSession), numbered(docs).withColumn("text_hash", F.xxhash64("text"))
    rows = s.cut(texts.select("node", "text_hash", "text").mapInArrow(_sets, _SETS), "sketches")
    # a doc_id with several sets: all but one of them get nodes of their own, linked with it in the end
    several = rows.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("s1", "s2")).alias("own"), F.max(F.struct("s1", "s2")).alias("last")).where("own != last").select("node", "own")
    several = s.cut(several, "several")
    more = None
    if several.limit(1).count():
        further = rows.join(several, "node").where("n_shingles > 0 and struct(s1, s2) != own")
        more = s.cut(further.select("node", "text_hash", (F.lit(MORE_SETS) + F.shiftrightunsigned(F.xxhash64("node", "s1", "s2"), 4)).alias("extra")).distinct(), "more")
        renamed = lambda d: d.join(more, ["node", "text_hash"], "left").withColumn("doc", F.col("node")).withColumn("node", F.coalesce("extra", "node")).drop("extra")
        rows, texts = s.cut(renamed(rows), "sketches"), renamed(texts).drop("doc")
    else:
        rows = rows.withColumn("doc", F.col("node"))
    texts = texts.select("node", "text")
    full = rows.where("n_shingles > 0")
    # a table of its own, so that the join's partition of a hot set can be split
    of_set = s.cut(full.groupBy("s1", "s2").agg(F.min("node").alias("rep")), "sets")
    member = s.cut(full.select("node", "s1", "s2").join(of_set, ["s1", "s2"]).select("node", "rep").distinct(), "members")
    classes = full.join(of_set.select(F.col("rep").alias("node")), "node").dropDuplicates(["node"])
    classes = s.cut(classes, "classes")
    keys = classes.select("node", F.explode("bands").alias("key"))
    order = F.struct(F.xxhash64("node").alias("o"), F.col("node").alias("centre"))
    centres = keys.groupBy("key").agg(F.min(order).alias("c"), F.count("*").alias("n")).where("n > 1").select("key", "c.centre")
    crowded = s.cut(keys.join(centres, "key"), "buckets")
    pairs = crowded.where("node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    # texts of classes that share a bucket: the only ones whose sets may be compared; moved once
    pool = s.cut(texts.join(crowded.select("node").distinct(), "node"), "pool")
    check = _Pairs(pool, classes, percent, margin, s)
    likely = s.cut(check.likely(pairs), "likely")
    links = s.cut(check.confirmed(likely.select("a", "b")), "links")
    comp = components(links, s)
    # what a bucket still holds of other components than its largest: each of them against all members of another one
    held = crowded.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    sizes = held.groupBy("key", "comp").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("comps"), F.sum("n").alias("n"))
    left = s.cut(held.join(split.where("comps > 1").select("key", "n", F.col("m.comp").alias("main")), "key"), "left")
    few = left.where(f"n <= {SMALL}")
    odd = few.where("comp != main").select("key", F.col("node").alias("x"), F.col("comp").alias("cx"))
    more_pairs = odd.join(few.select("key", "node", "comp", "main"), "key").where("cx != comp and (comp = main or x < node)")
    more_pairs = more_pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    found = s.cut(check.likely(more_pairs), "likely").select("a", "b")
    in_blocks = s.cut(_in_blocks(left.where(f"n > {SMALL}"), pool, percent), "links")
    # the components so far stand for their links; further sets of a doc_id belong to it
    links = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a != b").union(s.cut(check.confirmed(found), "links")).union(in_blocks)
    if more is not None:
        own = lambda c: member.select(F.col("node").alias(c), F.col("rep").alias(f"{c}_rep"))
        same = more.select(F.col("node").alias("a"), F.col("extra").alias("b")).distinct().join(own("a"), "a").join(own("b"), "b")
        links = links.union(same.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).where("a != b"))
    comp = components(links, s)
    whole = member.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("node", F.coalesce("component", "rep").alias("component"))
    out = rows.select("doc", "node", "n_shingles").join(whole, "node", "left").select(F.col("doc").alias("node"), "n_shingles", F.coalesce("component", "doc").alias("component"))
    return s.done(out)


def result(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row."""
    x = with_ids(near_duplicates(docs, percent), docs, "node", "component")
    kept = F.coalesce(F.col("doc_id") == F.col("least_id"), F.col("node") == F.col("component"))
    return x.select("doc_id", "n_shingles", F.col("least_id").alias("component_id"), kept.alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that stay: the least document of each group; of rows with one doc_id a single one."""
    x = near_duplicates(docs, percent)
    if whole_ids(docs):
        kept = x.where("node = component").select("node").distinct()
    else:
        first = with_ids(x, docs, "node", "component").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("m"))
        kept = first.select("m.node")
    (node,) = spare_names(docs, "node")
    x = docs.withColumn(node, node_column(docs)).join(kept.withColumnRenamed("node", node), node, "left_semi")
    return x.dropDuplicates([node]).drop(node)
