"""Conversation prefix trie (operator 13) by Patricia construction.

Every conversation is rebuilt from the opening turns of the first one of its twenty and its own later turns.  A turn is
known by a digest of role and text; a prefix by its depth and two sums of hashes over (place, digest), which Spark adds
up for any part of a conversation, so that a long one needs no task of its own: it is cut into segments of ``SEGMENT``
turns, each of which hangs at the node where the one before it ends.

Equal segments at the same node are counted first, so that a prefix that many share is one row.  Distinct segments are
then range-sorted by (node, turns), and each partition builds a Patricia trie of its own with a stack over neighbours'
common prefixes: only branch, end and leaf points, with compressed edges between.  Where a node has members in more than
one partition, it lies on the path of a partition's first or last row; on these paths every depth is a point, so that
partial points meet by their key and their sums add up.

Aggregates are made on the compressed trie.  A conversation is the smallest member of the nodes from some depth of its
path on; let its shared words be those before that depth, which some smaller conversation has too.  Then in the subtree
of a node at depth d with n members, words saved are the shared words of all its members but the smallest, less n - 1
times the words above depth d, and leaves are the members that are the smallest at a childless end.  Both are sums over
members, so no walk over the trie is needed, however deep it is: one pass finds smallest members, a second one adds
up.  Last, edges are expanded to their unary nodes: these have the members of the point below, and (n - 1) times the words
of the turns from there to the point (the edge's suffix sum) on top of its saved words.

``ends_sha256`` needs the ids of one node in order in one stream, by its definition; ids alone go there, and none are held.

Defined results: rows without conv_id take no part; a null role or text is empty; turns sort by turn, null first, then
by their digest, and repeated rows are turns of their own; a conversation left without turns ends at the root; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common

#: Turns of a segment; segments whose sums are added up in one window.
SEGMENT = 64
SEGMENTS_TOGETHER = 1024

_WORD = r"[^\x20\x09-\x0D]+"
_KEY = ["depth", "a", "b"]
_UP = ["up_depth", "up_a", "up_b"]


# ---- turns ----------------------------------------------------------------------------------------------------------
def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, digest, words``: the turns of each conversation in order, from 0."""
    role, text = common.text_or_empty("role"), common.text_or_empty("text")
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))
    order = ["conv_id", "turn", "digest"]
    rows = common.staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "trie-turns")
    counts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "digest")) - 1
    return rows.withColumn("within", within).join(counts.select("conv_id", "part", before.alias("before")), ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("within")).alias("place"), "digest", "words")


def rebuilt(turns: DataFrame, of: int, most: int) -> tuple[DataFrame, DataFrame]:
    """All conversations (``conv_id``), and ``conv_id, depth, digest, words`` of their rebuilt turns."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most + 1))
    convs = own.select("conv_id", (F.col("conv_id") - F.col("conv_id") % of).alias("base"), taken.alias("h"))
    convs = convs.join(own.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    convs = convs.select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("opening"))
    rest = turns.join(convs, "conv_id").where("place >= h").select("conv_id", (F.col("opening") + F.col("place") - F.col("h") + 1).alias("depth"), "digest", "words")
    openings = turns.where((F.col("place") < most) & (F.col("conv_id") % of == 0)).withColumnRenamed("conv_id", "base")
    heads = convs.join(openings, "base").where("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "words")
    return convs.select("conv_id"), rest.unionByName(heads)


def _wrapped(total: Column) -> Column:
    """A decimal modulo 2**64, as a long."""
    left = F.pmod(total, F.expr("18446744073709551616BD"))
    return F.when(left >= F.expr("9223372036854775808BD"), left - F.expr("18446744073709551616BD")).otherwise(left).cast("long")


def segments(turns: DataFrame) -> DataFrame:
    """``conv_id, segment, depth0, a0, b0, before, turns``: segments and the node at which each hangs."""
    hashed = turns.select("conv_id", F.expr(f"(depth - 1) DIV {SEGMENT}").alias("segment"), "depth", F.xxhash64("depth", "digest").alias("a"), F.xxhash64("digest", "depth").alias("b"), "words")
    cut = hashed.groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("depth", "a", "b", "words"))).alias("turns"),  # at most SEGMENT
        *(F.sum(F.col(c).cast("decimal(20,0)")).alias(f"sum_{c}") for c in ("a", "b", "words")),
    ).withColumn("together", F.expr(f"segment DIV {SEGMENTS_TOGETHER}"))
    cut = common.staged(cut, "trie-cut")
    earlier = Window.partitionBy("conv_id").orderBy("together").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("conv_id", "together").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("conv_id", "together").agg(*(F.sum(f"sum_{c}").alias(c) for c in ("a", "b", "words")))
    sums = sums.select("conv_id", "together", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_earlier") for c in ("a", "b", "words")))
    at = {c: F.coalesce(F.sum(f"sum_{c}").over(here), F.lit(0)) for c in ("a", "b", "words")}
    cut = cut.withColumns({f"{c}_here": column for c, column in at.items()}).join(sums, ["conv_id", "together"])
    total = {c: F.col(f"{c}_here") + F.col(f"{c}_earlier") for c in at}
    return cut.select(
        "conv_id", "segment", (F.col("segment") * SEGMENT).alias("depth0"), _wrapped(total["a"]).alias("a0"), _wrapped(total["b"]).alias("b0"), total["words"].cast("long").alias("before"),
        F.transform("turns", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["words"].alias("words"))).alias("turns"),
        _wrapped(total["a"] + F.col("sum_a")).alias("a"), _wrapped(total["b"] + F.col("sum_b")).alias("b"), (total["words"] + F.col("sum_words")).cast("long").alias("after"),
    )


# ---- the compressed trie --------------------------------------------------------------------------------------------
_POINT = {
    "depth": pa.int64(), "a": pa.int64(), "b": pa.int64(), "up_depth": pa.int64(), "up_a": pa.int64(), "up_b": pa.int64(), "up_words": pa.int64(), "suffixes": pa.list_(pa.int64()),
    "n": pa.int64(), "conv_id": pa.int64(), "own": pa.int64(), "shared": pa.int64(), "leaves": pa.int64(),
}
_POINT_DDL = ", ".join(f"{name} {'array<bigint>' if name == 'suffixes' else 'bigint'}" for name in _POINT)


def _sums(start: int, values: list[int]) -> list[int]:
    """Running sums of longs from ``start``, wrapped."""
    return (np.cumsum(np.array([start, *values], np.int64).view(np.uint64))).view(np.int64).tolist()


class Patricia:
    """A trie over sorted rows of one partition; points are given out once no later row can pass through them."""

    def __init__(self):
        self.node, self.stack, self.out = None, [], []

    def add(self, node: tuple, turns: tuple, values: tuple) -> None:
        """``node``: (depth, a, b, words) where the row hangs; ``values``: (members, (smallest, its own), shared, leaves)."""
        first = self.node is None
        if node == self.node:
            kept = 0
            for mine, theirs in zip(turns, self.turns, strict=False):
                if mine != theirs:
                    break
                kept += 1
            self.close(kept)
        else:
            self.close(0)
            kept, self.stack = 0, []
        self.node, self.turns = node, turns
        depth, a, b, words = node
        self.a, self.b = _sums(a, [t[0] for t in turns]), _sums(b, [t[1] for t in turns])
        self.words = np.cumsum([words, *(t[2] for t in turns)]).tolist()
        if first:  # the partition before may have members of any node on this path
            self.stack = [[d, None] for d in range(1, len(turns))]
        self.stack.append([len(turns), values])

    def close(self, depth: int) -> None:
        """Give out the points below ``depth`` on the last row's path; what hangs together there gets a point."""
        stack = self.stack
        while stack and stack[-1][0] > depth:
            at, values = stack.pop()
            if not stack or stack[-1][0] < depth:
                stack.append([depth, None])
            up = stack[-1][0]
            if up > 0:
                held = stack[-1][1]
                stack[-1][1] = values if held is None else (held[0] + values[0], min(held[1], values[1]), held[2] + values[2], held[3] + values[3])
            top = self.node[0]
            ends = self.words[at - 1]
            self.out.append((top + at, self.a[at], self.b[at], top + up, self.a[up], self.b[up], self.words[up], [ends - w for w in self.words[up:at]], values[0], *values[1], values[2], values[3]))
            if up == 0:
                stack.pop()
                break

    def finish(self) -> None:
        """The partition after may have members of any node on the last path."""
        if self.stack:
            for depth in range(self.stack[-1][0] - 1, -1, -1):
                self.close(depth)

    def given(self) -> pa.RecordBatch:
        columns = zip(*self.out, strict=True) if self.out else [[]] * len(_POINT)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _POINT.values(), strict=True)], names=list(_POINT))
        self.out = []
        return batch


def _grow(batches):
    trie = Patricia()
    for batch in batches:
        column = {name: common.column_of(batch, name) for name in batch.schema.names}
        lists = column["turns"]
        at, flat = lists.offsets.to_pylist(), lists.values
        turns = list(zip(*(flat.field(k).to_pylist() for k in range(3)), strict=True))
        plain = [column[c].to_pylist() for c in ("depth0", "a0", "b0", "before", "n", "conv_id", "own", "shared", "leaves")]
        for k, (depth, a, b, words, n, conv, own, shared, leaves) in enumerate(zip(*plain, strict=True)):
            trie.add((depth, a, b, words), tuple(turns[at[k] : at[k + 1]]), (n, (conv, own), shared, leaves))
        yield trie.given()
    trie.finish()
    yield trie.given()


def compressed(cut: DataFrame) -> DataFrame:
    """Points below the root with their edges and sums over members; ``cut`` has ``own`` and ``leaf`` of its conversation."""
    hang = ["depth0", "a0", "b0", "before", "turns"]
    distinct = cut.groupBy(*hang).agg(F.count("*").alias("n"), F.min(F.struct("conv_id", "own")).alias("least"), F.sum("own").alias("shared"), F.sum("leaf").alias("leaves"))
    distinct = distinct.select(*hang, "n", "least.conv_id", "least.own", "shared", "leaves")
    order = ["depth0", "a0", "b0", "turns"]
    partial = distinct.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_grow, _POINT_DDL)
    merged = partial.groupBy(*_KEY).agg(
        *(F.first(c).alias(c) for c in (*_UP, "up_words", "suffixes")), F.sum("n").alias("n"), F.min(F.struct("conv_id", "own")).alias("least"), F.sum("shared").alias("shared"), F.sum("leaves").alias("leaves")
    )
    return merged.select(*_KEY, *_UP, "up_words", "suffixes", "n", "least.conv_id", "least.own", "shared", "leaves")


def _above(points: DataFrame, root: DataFrame) -> DataFrame:
    """``points`` with the smallest member of the point above, ``up_conv_id``; the root, above most of them, is one row."""
    inner = points.where("up_depth > 0").join(points.select(*(F.col(c).alias(u) for c, u in zip(_KEY, _UP, strict=True)), F.col("conv_id").alias("up_conv_id")), _UP)
    outer = points.where("up_depth = 0").join(F.broadcast(root.select(F.lit(0).cast("long").alias("up_depth"), F.col("conv_id").alias("up_conv_id"))), "up_depth")
    return inner.unionByName(outer)


def digests(ends: DataFrame) -> DataFrame:
    """``depth, a, b, ends_sha256``: hashes of the ids that end at a node, read as one sorted stream."""

    def run(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for depth, a, b, conv in zip(*(common.column_of(batch, c).to_pylist() for c in (*_KEY, "conv_id")), strict=True):
                if (depth, a, b) != key:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (depth, a, b), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield _digest_batch(done)
        yield _digest_batch([(*key, digest.hexdigest())] if key else [])

    return ends.select(*_KEY, "conv_id").repartition(*_KEY).sortWithinPartitions(*_KEY, "conv_id").mapInArrow(run, "depth bigint, a bigint, b bigint, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*_KEY, "ends_sha256"])


# ---- the operator ---------------------------------------------------------------------------------------------------
def nodes(conversations: DataFrame, of: int = 20, most: int = 3) -> DataFrame:
    """One row for each node of the trie over the rebuilt conversations."""
    convs, turns = rebuilt(common.staged(numbered(conversations), "trie-numbered"), of, most)
    convs = common.staged(convs, "trie-convs")
    cut = common.staged(segments(turns), "trie-segments")
    last = cut.groupBy("conv_id").agg(F.max(F.struct("segment", (F.col("depth0") + F.size("turns")).alias("depth"), "a", "b", "after")).alias("last"))
    ends = convs.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(f"last.{c}", F.lit(0)).alias(c) for c in (*_KEY, "after")))
    ends = common.staged(ends, "trie-ends")
    smallest = convs.agg(F.min("conv_id").alias("conv_id")).where("conv_id IS NOT NULL")

    points = common.staged(compressed(cut.withColumns({"own": F.lit(0).cast("long"), "leaf": F.lit(0).cast("long")})), "trie-points")
    parents = points.select(*_UP).distinct().toDF(*_KEY)
    begun = _above(points, smallest).where("conv_id <> up_conv_id").select("conv_id", F.col("up_words").alias("own"))
    begun = begun.unionByName(smallest.select("conv_id", F.lit(0).cast("long").alias("own")))
    leaf = points.join(parents, _KEY, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    own = ends.join(begun, "conv_id", "left").join(leaf, "conv_id", "left").select("conv_id", F.coalesce("own", "after").alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    own = common.staged(own, "trie-own")

    points = common.staged(compressed(cut.join(own, "conv_id")), "trie-sums")
    children = points.groupBy(*_UP).agg(F.count("*").alias("children")).toDF(*_KEY, "children")
    beside = children.join(digests(ends), _KEY, "full")
    beside = common.staged(beside, "trie-beside")
    many = F.col("n") - 1
    below = _above(points, smallest).join(beside, _KEY, "left")
    below = below.withColumn("saved", F.col("shared") - F.col("own") - many * (F.col("up_words") + F.col("suffixes")[0]))
    below = below.select("*", F.posexplode("suffixes").alias("k", "suffix")).withColumn("at_point", F.col("k") == F.size("suffixes") - 1)
    nothing = F.lit(hashlib.sha256().hexdigest())
    below = below.select(
        "conv_id", (F.col("up_depth") + 1 + F.col("k")).alias("depth"), F.when(F.col("k") == 0, F.col("up_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(F.col("at_point"), F.coalesce("children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + many * F.col("suffix")).alias("saved_tokens"), F.when(F.col("at_point"), F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256"),
    )
    sums = own.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("own").alias("saved_tokens"), F.sum("leaf").alias("leaves"), F.lit(0).cast("long").alias("depth")).where("n_convs > 0")
    top = sums.join(beside.where("depth = 0").select("depth", "children", "ends_sha256"), "depth", "left").select(
        "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("children", F.lit(0)).cast("long").alias("n_children"),
        F.greatest("leaves", F.lit(1)).alias("n_leaves"), "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    return below.unionByName(top)
