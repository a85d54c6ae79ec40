"""Prefix trie of conversations, summed over subtrees by heavy-path decomposition.

A node is a distinct sequence of first turns (role, text). Its key is a sum of 128 hash bits of each turn and its place, so keys
of a long conversation are prefix sums, which are built in chunks like all running sums here. Every node's child with the
most members is heavy (ties: least member), every other one is light and has at most half of its parent's members. A
heavy path ends in a leaf; it is named by the leaf's least member and begins at that member's last light node, so all paths follow
from one grouping, without a walk. Sums of whole light paths are attached to their parents from the deepest level on: as many rounds
as a conversation meets light nodes, at most the logarithm of their number. Then one suffix sum along every path is the answer.

Cases: a null role or text is empty; turns of equal number go by a hash of role and text; a null turn comes first; repeated rows are
repeated turns; a row whose conv_id is null or no integer takes no part; an empty table gives an empty result (no root); texts of any length are hashed
within the scan and go no further; columns other than conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.store import Scratch, own_columns

#: Conversations c to c + BASE - 1 share first turns of conversation c; at most SHARED - 1 of them.
BASE, SHARED = 100, 6
#: Rows of a running sum that one window takes.
CHUNK = 4096
KEY = ["k1", "k2"]


def running(df: DataFrame, group: str, place: str, values: list[str], scratch: Scratch, backwards: bool = False) -> DataFrame:
    """``values`` of a written table replaced by their sums from the first row of ``group`` by ``place`` on (or from the last one back).

    Sums go over chunks of places first and over the chunks' totals then, so no window holds a whole group.
    """
    df = df.withColumn("_chunk", F.floor(F.col(place) / CHUNK))
    way = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    before = Window.partitionBy(group).orderBy(way("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(group, "_chunk").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    totals = totals.select(group, "_chunk", *[F.sum(f"_{v}").over(before).alias(f"_{v}") for v in values]).where(F.col(f"_{values[0]}").isNotNull())
    inside = Window.partitionBy(group, "_chunk").orderBy(way(place)).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumns({v: F.sum(v).over(inside) for v in values}).join(scratch.cut(totals, "totals"), [group, "_chunk"], "left")
    return summed.withColumns({v: F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0)) for v in values}).drop("_chunk", *[f"_{v}" for v in values])


def ordered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, turn, place (from 1), two hashes of role and text, and code points of the text.

    Rows are dealt by ranges of their order, so a conversation of any length lies in several parts; places within a part
    get the number of its conversation's rows in earlier parts added.
    """
    own = own_columns(conversations, "conv_id", "turn", "role", "text")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = own.select(
        F.col("conv_id").try_cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), role, text).alias("h2"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"),
    ).where("conv_id is not null")
    order = ["conv_id", F.asc_nulls_first("turn"), "h1", "h2", "row"]
    dealt = scratch.cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = dealt.groupBy("conv_id", "part").count().select("conv_id", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("conv_id", "part").orderBy(*order[1:])
    placed = dealt.withColumn("place", F.row_number().over(inside)).join(scratch.cut(offset.where("offset > 0"), "offsets"), ["conv_id", "part"], "left")
    out = scratch.cut(placed.select("conv_id", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("place"), "h1", "h2", "chars"), "placed")
    scratch.drop(dealt)
    return out


def rebuilt(turns: DataFrame, scratch: Scratch, share: bool) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their steps (conv_id, depth, hashes, chars, whether the last).

    With ``share`` the first turns of conversation c - c % BASE stand for the own ones, of a number that a hash of c says.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % SHARED if share else F.lit(0).cast("long")
    convs = turns.groupBy("conv_id").count().select("conv_id", "count", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BASE).alias("base"))
    head = F.struct("place", "h1", "h2", "chars")
    heads = turns.where(f"place < {SHARED} and conv_id % {BASE} = 0").groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(head)).alias("head"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.when(F.col("h") > 0, F.slice("head", F.lit(1), F.greatest(F.col("h").cast("int"), F.lit(1)))))
    convs = convs.withColumn("m", F.greatest(F.size("head"), F.lit(0)).cast("long")).withColumn("length", F.col("m") + F.greatest(F.col("count") - F.col("h"), F.lit(0)))
    convs = scratch.cut(convs.select("conv_id", "h", "m", "length", "head"), "conversations")
    shared = convs.select("conv_id", "length", F.explode("head").alias("x")).select("conv_id", "length", F.col("x.place").cast("long").alias("depth"), "x.h1", "x.h2", "x.chars")
    tail = turns.join(convs.select("conv_id", "h", "m", "length"), "conv_id").where("place > h").select("conv_id", "length", (F.col("place") - F.col("h") + F.col("m")).alias("depth"), "h1", "h2", "chars")
    steps = shared.unionByName(tail).select("conv_id", "depth", "h1", "h2", "chars", (F.col("depth") == F.col("length")).alias("last"))
    return convs, scratch.cut(steps, "steps")


def keyed(steps: DataFrame, scratch: Scratch) -> DataFrame:
    """Steps with the key of their node (k1, k2) and of its parent (q1, q2); the root's is (0, 0)."""
    low = 0xFFFFFFFF
    a, b = F.xxhash64("depth", "h1", "h2"), F.xxhash64(F.lit(3), "h2", "h1", "depth")
    words = {"s0": F.shiftrightunsigned(a, 32), "s1": a.bitwiseAND(F.lit(low)), "s2": F.shiftrightunsigned(b, 32), "s3": b.bitwiseAND(F.lit(low))}
    # sums of 32 bits in 64 never overflow; keys keep their lowest 32 bits
    summed = running(scratch.cut(steps.select("conv_id", "depth", "chars", "last", *[w.alias(s) for s, w in words.items()], *[w.alias(f"o{s}") for s, w in words.items()]), "terms"), "conv_id", "depth", list(words), scratch)
    key = lambda x, y: F.shiftleft(x.bitwiseAND(F.lit(low)), 32).bitwiseOR(y.bitwiseAND(F.lit(low)))
    now, old = [F.col(s) for s in words], [F.col(s) - F.col(f"o{s}") for s in words]
    return scratch.cut(summed.select("conv_id", "depth", "chars", "last", key(now[0], now[1]).alias("k1"), key(now[2], now[3]).alias("k2"), key(old[0], old[1]).alias("q1"), key(old[2], old[3]).alias("q2")), "keyed")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv_id) to a row per node and batch: the ids' text, and the first of them."""
    for batch in batches:
        k1, k2, ids = (batch.column(i).to_pylist() for i in range(3))
        at = [i for i in range(len(ids)) if not i or k1[i] != k1[i - 1] or k2[i] != k2[i - 1]]
        text = [",".join(map(str, ids[a:b])) for a, b in zip(at, [*at[1:], len(ids)])]
        yield pa.record_batch([pa.array([c[i] for i in at], pa.int64()) for c in (k1, k2, ids)] + [pa.array(text, pa.string())], names=["k1", "k2", "first", "text"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to a digest per node; only the digest's state is held."""
    names, key, h = ["k1", "k2", "ends_sha256"], None, None
    made = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), (pa.int64(), pa.int64(), pa.string()))], names=names)
    for batch in batches:
        out = []
        for k1, k2, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
            if (k1, k2) == key:
                h.update(b",")
            else:
                if key is not None:
                    out.append((*key, h.hexdigest()))
                key, h = (k1, k2), hashlib.sha256()
            h.update(text.encode())
        if out:
            yield made(out)
    if key is not None:
        yield made([(*key, h.hexdigest())])


def digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's conversations that end there: ids are joined to pieces by ranges, and a node's pieces hashed in order."""
    pieces = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_pieces, "k1 long, k2 long, first long, text string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def tree(convs: DataFrame, steps: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per node: least member, members, children, parent's least member, and whether the node is light."""
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    zero = [F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "depth", "chars")]
    none = [F.lit(None).cast("long").alias(c) for c in ("q1", "q2")]
    nodes = steps.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.max(c).alias(c) for c in ("depth", "chars", "q1", "q2")])
    nodes = scratch.cut(nodes.unionByName(root.select("conv_id", "n_convs", *zero, *none)), "nodes")
    # of children with as many members, the one with the least member: ~x falls as x rises
    kids = nodes.where("depth > 0").groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("n_children"), F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("least"), "k1", "k2")).alias("heavy"))
    full = nodes.join(kids.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), "n_children", "heavy"), KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    full = scratch.cut(full, "families")
    parents = full.where("n_children > 0").select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy.k1").alias("h1"), F.col("heavy.k2").alias("h2"))
    own = full.drop("heavy").join(parents, ["q1", "q2"], "left")
    out = scratch.cut(own.withColumn("light", F.coalesce(~((F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))), F.lit(False))).drop("h1", "h2"), "tree")
    scratch.drop(nodes, full)
    return out


def subtree_sums(nodes: DataFrame, steps: DataFrame, scratch: Scratch) -> DataFrame:
    """k1, k2, n_leaves and saved_tokens of every node, summed over its subtree."""
    leaves = nodes.where("n_children = 0").select("conv_id", F.col("depth").alias("leaf_depth"))
    seen = steps.select("conv_id", *KEY, "q1", "q2").join(leaves.select("conv_id"), "conv_id", "left_semi")
    value = nodes.select(*KEY, "depth", "light", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    rows = seen.join(value, KEY)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = leaves.select("conv_id", zero.alias("k1"), zero.alias("k2"), none.alias("q1"), none.alias("q2"), zero.alias("depth"), F.lit(False).alias("light"), (F.col("leaf_depth") == 0).cast("long").alias("n_leaves"), zero.alias("saved_tokens"))
    rows = scratch.cut(rows.unionByName(root), "walks")
    # a path begins at the last light node of its leaf's walk; its level is the number of light nodes up to there
    tops = rows.groupBy("conv_id").agg(F.max(F.when(F.col("light"), F.col("depth")).otherwise(0)).alias("top"), F.sum(F.col("light").cast("long")).alias("level"))
    on_path = scratch.cut(rows.join(tops, "conv_id").where("depth >= top").drop("light"), "paths")
    scratch.drop(rows)
    own = on_path.groupBy("conv_id", "top", "level").agg(*[F.sum(v).alias(v) for v in ("n_leaves", "saved_tokens")], *[F.max(F.when(F.col("depth") == F.col("top"), F.col(q))).alias(q) for q in ("q1", "q2")])
    above = on_path.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("up"), F.col("depth").alias("up_depth"))
    paths = scratch.cut(own.join(above, ["q1", "q2"], "left").select("conv_id", "level", "n_leaves", "saved_tokens", "up", "up_depth"), "path")
    deepest = paths.agg(F.max("level")).first()[0] or 0
    attached, below = [], None
    for level in range(deepest, 0, -1):
        now = paths.where(F.col("level") == level)
        if below is not None:
            add = below.groupBy(F.col("up").alias("conv_id")).agg(F.sum("n_leaves").alias("a"), F.sum("saved_tokens").alias("b"))
            now = now.join(add, "conv_id", "left").withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("a", zero), "saved_tokens": F.col("saved_tokens") + F.coalesce("b", zero)})
        below = scratch.cut(now.select("up", "up_depth", "n_leaves", "saved_tokens"), "attached")
        attached.append(below)
    whole = on_path.select("conv_id", "depth", *KEY, "n_leaves", "saved_tokens")
    if attached:
        extra = attached[0]
        for t in attached[1:]:
            extra = extra.union(t)
        extra = extra.groupBy(F.col("up").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.sum("n_leaves").alias("a"), F.sum("saved_tokens").alias("b"))
        whole = whole.join(extra, ["conv_id", "depth"], "left").select("conv_id", "depth", *KEY, (F.col("n_leaves") + F.coalesce("a", zero)).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("b", zero)).alias("saved_tokens"))
    whole = scratch.cut(whole, "values")
    scratch.drop(on_path, paths, *attached)
    return running(whole, "conv_id", "depth", ["n_leaves", "saved_tokens"], scratch, backwards=True).select(*KEY, "n_leaves", "saved_tokens")


def nodes(conversations: DataFrame, share: bool = True) -> DataFrame:
    """All nodes of the trie, with their keys (k1, k2); ``share`` says whether conversations are rebuilt on shared first turns first."""
    scratch = Scratch(conversations.sparkSession)
    turns = ordered(conversations, scratch)
    convs, plain = rebuilt(turns, scratch, share)
    steps = keyed(plain, scratch)
    scratch.drop(turns, plain)
    all_nodes = tree(convs, steps, scratch)
    sums = subtree_sums(all_nodes, steps, scratch)
    zero = F.lit(0).cast("long")
    ends = steps.where("last").select(*KEY, "conv_id").union(convs.where("length = 0").select(zero, zero, "conv_id"))
    joined = all_nodes.join(sums, KEY).join(digests(ends), KEY, "left")
    none: Column = F.lit(hashlib.sha256().hexdigest())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return scratch.done(joined.select(*columns, F.coalesce("ends_sha256", none).alias("ends_sha256"), *KEY), "trie")


def result(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations' trie."""
    return nodes(conversations).drop(*KEY)
