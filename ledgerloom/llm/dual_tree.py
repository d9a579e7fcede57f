"""Hard-negative mining (operator 12) by dual-tree search.

Every component of a vector becomes ``floor(scale * x)``, so scores are whole numbers and exact.  Rows are sorted by label
and by the cell of a tree of splits fitted on a bounded sample (``SAMPLE_VALUES``), and cut into blocks of at most
``BLOCK`` rows; a hot label or cell fills many blocks.  Anchors, a stated query set, are blocks in the same order.
The upper level of both trees are the blocks' balls: pairs of an anchor block and a candidate block whose interval of
inner products, ``centre . centre +- (|centre| radius + radius |centre| + radius radius)``, holds no score that an anchor
still looks for don't meet at all.  Pairs that meet are searched by a tree over the anchors and one over the candidates:
the interval of two nodes prunes all anchors of the one against all candidates of the other, and leaf pairs are scored
exactly.  What an anchor looks for begins at the fifth best score in the sample, a lower bound, and rises with what is
found.  Nodes also carry their range of labels, so that nodes of one label are pruned where another is asked for.

The search runs twice: for the best rows of an anchor's label (its positives), then, for each of these, for the best
rows of other labels in the window of scores that belongs to it.  Partial results of the block pairs meet in a ranked
top five, which Spark limits before it shuffles.

Defined results: rows without vec_id, label or vector, with a null or non-finite component, or with a squared length of
2**62 and more (whose scores might not fit a long) take no part.  Vectors of unequal length are compared over the
components that both have.  Rows that repeat vec_id, label and vector count once; other rows of one vec_id stand for
themselves.  Ties go to the smaller vec_id.  Anchors without positives, and positives without negatives, give no rows;
so does an empty table.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common

#: Values (rows times components) of the sample that cells and first bounds come from; it is broadcast.
SAMPLE_VALUES = 1 << 20
#: Candidates of a block at most, and at least where there are few rows; anchors of a block.
BLOCK, LEAST_BLOCK, ANCHOR_BLOCK = 16384, 1024, 4096
#: Anchor blocks that meet one candidate block do so in so many tasks.
TURNS = 16
LEAF, ANCHOR_LEAF = 256, 32
CELL_ROWS = 64

_NONE = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


# ---- rows -----------------------------------------------------------------------------------------------------------
def scaled(vectors: DataFrame, scale: int, anchor_step: int, relabel_step: int, labels: int) -> DataFrame:
    """``vec_id, label, anchor, dims, vec``: rows that take part, components as little-endian integers."""
    label = F.col("label").cast("long")
    rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(
        "vec_id", F.when(F.col("vec_id") % relabel_step == 0, (label + 1) % labels).otherwise(label).alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )

    def whole(batches):
        for batch in batches:
            column = common.column_of(batch, "embedding")
            at = column.offsets.to_numpy().astype(np.int64)
            flat = column.values
            missing = np.zeros(len(flat), bool) if not flat.null_count else flat.is_null().to_numpy(zero_copy_only=False)
            values = flat.to_numpy(zero_copy_only=False)
            with np.errstate(all="ignore"):
                values = np.floor(values * scale)
                bad = np.r_[0, np.cumsum(missing | ~(np.abs(values) < 2.0**31))]
            keep = np.flatnonzero(bad[at[1:]] == bad[at[:-1]])
            out = []
            for k in keep.tolist():
                v = values[at[k] : at[k + 1]]
                if v @ v >= 2.0**62:
                    continue
                most = np.abs(v).max(initial=0)
                out.append((k, len(v), v.astype("<i2" if most < 2**15 else "<i4").tobytes()))
            ids, label = (common.column_of(batch, c).to_numpy(zero_copy_only=False)[[k for k, *_ in out]] if out else np.zeros(0, np.int64) for c in ("vec_id", "label"))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label), pa.array(ids % anchor_step == 0), pa.array([d for _, d, _ in out], pa.int32()), pa.array([v for *_, v in out], pa.binary())], names=["vec_id", "label", "anchor", "dims", "vec"])

    return rows.mapInArrow(whole, "vec_id bigint, label bigint, anchor boolean, dims int, vec binary")


def matrix(vecs: list[bytes], dims: list[int]) -> np.ndarray:
    """Vectors as rows of one matrix, shorter ones with zeros at the end."""
    out = np.zeros((len(vecs), max(dims, default=0)))
    for row, v, d in zip(out, vecs, dims, strict=True):
        row[:d] = np.frombuffer(v, f"<i{len(v) // d}") if d else 0
    return out


def common_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = min(a.shape[1], b.shape[1])
    return a[:, :d], b[:, :d]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows as longs: in floating point where no sum can pass 2**53."""
    a, b = common_width(a, b)
    reach = np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0))
    return (a @ b.T).astype(np.int64) if reach < 2.0**52 else a.astype(np.int64) @ b.T.astype(np.int64)


# ---- trees ----------------------------------------------------------------------------------------------------------
def split(x: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Direction between two far rows and the middle along it; None where all rows are equal."""
    far = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    direction = x[((x - far) ** 2).sum(1).argmax()] - far
    along = x @ direction
    cut = float(np.median(along))
    if not (along > cut).any():
        cut = float((along.min() + along.max()) / 2)
    return (direction, cut) if (along > cut).any() and (along <= cut).any() else None


def fit_cells(x: np.ndarray, depth: int = 0) -> tuple | None:
    """Nested (direction, cut, below, above) of a sample."""
    found = split(x) if len(x) > CELL_ROWS and depth < 20 else None
    if not found:
        return None
    above = x @ found[0] > found[1]
    return (*found, fit_cells(x[~above], depth + 1), fit_cells(x[above], depth + 1))


def cells_of(x: np.ndarray, cells: tuple | None, rows: np.ndarray, out: np.ndarray, code: int = 1) -> None:
    """Write the number of each row's cell to ``out``; cells of one branch are neighbours in number."""
    level = code.bit_length()
    if cells is None or not len(rows):
        out[rows] = code << (24 - level)
        return
    a, b = common_width(x[rows], cells[0][None])
    above = a @ b[0] > cells[1]
    cells_of(x, cells[2], rows[~above], out, code * 2)
    cells_of(x, cells[3], rows[above], out, code * 2 + 1)


class Tree:
    """A binary tree of balls over rows: by label first, then by the direction between far rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int):
        order, nodes = np.arange(len(ids)), []

        def grow(first: int, last: int) -> int:
            rows = order[first:last]
            k = len(nodes)
            nodes.append([first, last, -1, -1])
            if last - first > leaf:
                own = labels[rows]
                if own.min() != own.max():
                    below = own <= (np.median(own) if (own > np.median(own)).any() else np.sort(own)[len(own) // 2] - 1)
                    below = own == own.min() if below.all() or not below.any() else below
                else:
                    found = split(x[rows])
                    below = x[rows] @ found[0] <= found[1] if found else np.arange(len(rows)) < len(rows) // 2
                order[first:last] = np.r_[rows[below], rows[~below]]
                middle = first + int(below.sum())
                nodes[k][2:] = grow(first, middle), grow(middle, last)
            else:
                order[first:last] = rows[np.argsort(ids[rows], kind="stable")]
            return k

        if len(ids):
            grow(0, len(ids))
        self.order, self.nodes = order, nodes
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.centre = np.array([self.x[a:b].mean(0) for a, b, *_ in nodes]).reshape(len(nodes), x.shape[1])
        self.radius = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(1).max()) for (a, b, *_), c in zip(nodes, self.centre, strict=True)])
        self.length = np.sqrt((self.centre**2).sum(1))
        self.low = [int(self.labels[a:b].min()) for a, b, *_ in nodes]
        self.high = [int(self.labels[a:b].max()) for a, b, *_ in nodes]


def interval(ca, la, ra, cb, lb, rb):
    """Least and greatest inner product of a row of one ball with a row of the other, with room for rounding."""
    middle = (ca * cb).sum(-1)
    reach = la * rb + lb * ra + ra * rb
    room = 1e-9 * (la + ra) * (lb + rb) + 1e-6
    return middle - reach - room, middle + reach + room


class Search:
    """The best ``most`` rows for each query of the anchors of one tree; a query is a window of scores."""

    def __init__(self, anchors: Tree, low: np.ndarray, high: np.ndarray, same: bool, most: int):
        self.a, self.low, self.high, self.same = anchors, low.copy(), high, same
        self.scores = np.full((*low.shape, most), _NONE)
        self.found = np.full((*low.shape, most), _MOST)

    def wanted(self, first: int, last: int, least: float, greatest: float) -> bool:
        return bool(((self.low[first:last] <= greatest) & (self.high[first:last] >= least)).any())

    def run(self, c: Tree) -> None:
        """Node pairs in order of their greatest possible score, so that what is looked for rises early."""
        a = self.a
        if not a.nodes or not c.nodes:
            return
        d = min(a.x.shape[1], c.x.shape[1])
        open_pairs: list[tuple[float, float, int, int]] = []

        def consider(i: int, j: int) -> None:
            apart = a.low[i] > c.high[j] or c.low[j] > a.high[i]
            if apart if self.same else a.low[i] == a.high[i] == c.low[j] == c.high[j]:
                return
            least, greatest = interval(a.centre[i, :d], a.length[i], a.radius[i], c.centre[j, :d], c.length[j], c.radius[j])
            if self.wanted(*a.nodes[i][:2], least, greatest):
                heapq.heappush(open_pairs, (-greatest, least, i, j))

        consider(0, 0)
        while open_pairs:
            greatest, least, i, j = heapq.heappop(open_pairs)
            (a0, a1, al, ar), (c0, c1, cl, cr) = a.nodes[i], c.nodes[j]
            if not self.wanted(a0, a1, least, -greatest):
                continue
            if al < 0 and cl < 0:
                self.score(a0, a1, c, c0, c1)
            elif cl < 0 or al >= 0 and a1 - a0 > c1 - c0:
                consider(al, j)
                consider(ar, j)
            else:
                consider(i, cl)
                consider(i, cr)

    def score(self, a0: int, a1: int, c: Tree, c0: int, c1: int) -> None:
        a, most = self.a, self.scores.shape[2]
        got = products(a.x[a0:a1], c.x[c0:c1])
        fits = (a.labels[a0:a1, None] == c.labels[None, c0:c1]) == self.same
        if self.same:
            for i, j in np.argwhere(fits & (a.ids[a0:a1, None] == c.ids[None, c0:c1])):
                fits[i, j] = np.trim_zeros(a.x[a0 + i], "b").tolist() != np.trim_zeros(c.x[c0 + j], "b").tolist()
        for q in range(self.low.shape[1]):
            held = fits & (got >= self.low[a0:a1, q, None]) & (got <= self.high[a0:a1, q, None])
            rows = np.flatnonzero(held.any(1))
            if not len(rows):
                continue
            score = np.concatenate([self.scores[a0 + rows, q], np.where(held[rows], got[rows], _NONE)], 1)
            ids = np.concatenate([self.found[a0 + rows, q], np.broadcast_to(c.ids[c0:c1], (len(rows), c1 - c0))], 1)
            ids = np.where(score == _NONE, _MOST, ids)
            best = np.lexsort((ids, ~score), axis=1)[:, :most]  # ~ turns the order round without overflow
            self.scores[a0 + rows, q] = np.take_along_axis(score, best, 1)
            self.found[a0 + rows, q] = np.take_along_axis(ids, best, 1)
            self.low[a0 + rows, q] = np.maximum(self.low[a0 + rows, q], self.scores[a0 + rows, q, -1])



# ---- blocks ---------------------------------------------------------------------------------------------------------
_BLOCK = "part int, block bigint, ids binary, labels binary, width int, vecs binary"


def blocks(rows: DataFrame, most: int, parts: int, name: str) -> DataFrame:
    """Rows in the order of label and cell, cut into blocks of at most ``most``; rows that repeat another are left out."""

    def cut(batches):
        part, n, held, last = TaskContext.get().partitionId(), 0, [], None

        def block(rows):
            ids, labels, dims, vecs = zip(*rows, strict=True)
            x = matrix(vecs, dims)
            kind = "<i2" if np.abs(x).max(initial=0) < 2**15 else "<i4"
            values = (part, (part << 32) + n, np.array(ids, "<i8").tobytes(), np.array(labels, "<i8").tobytes(), x.shape[1], x.astype(kind).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["part", "block", "ids", "labels", "width", "vecs"])

        for batch in batches:
            for row in zip(*(common.column_of(batch, c).to_pylist() for c in ("vec_id", "label", "dims", "vec")), strict=True):
                if row == last:
                    continue
                last = row
                held.append(row)
                if len(held) == most:
                    yield block(held)
                    held, n = [], n + 1
        if held:
            yield block(held)

    order = ["label", "cell", "spread", "vec_id"]
    return common.staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(cut, _BLOCK), name)


def opened(ids: bytes, labels: bytes, width: int, vecs: bytes, leaf: int) -> Tree:
    ids = np.frombuffer(ids, "<i8")
    x = np.frombuffer(vecs, f"<i{len(vecs) // (len(ids) * width)}").reshape(-1, width).astype(float) if width else np.zeros((len(ids), 0))
    return Tree(ids, np.frombuffer(labels, "<i8"), x, leaf)


def balls(table: DataFrame) -> DataFrame:
    """``part, block, centre, radius, low, high``: the ball and the labels of each block."""

    def measure(batches):
        for batch in batches:
            out = []
            for part, block, ids, labels, width, vecs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = opened(ids, labels, width, vecs, 1 << 62)
                out.append((part, block, t.centre[0].tobytes(), float(t.radius[0]), t.low[0], t.high[0]))
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["part", "block", "centre", "radius", "low", "high"])

    return table.mapInArrow(measure, "part int, block bigint, centre binary, radius double, low bigint, high bigint")


def first_bounds(queries: DataFrame, sample, same: bool, most: int) -> DataFrame:
    """Raise the lower ends of the windows of anchor blocks (``lows, highs``) to the scores found in the sample."""

    def bound(batches):
        known = Tree(*sample.value, LEAF)
        for batch in batches:
            lows = []
            for ids, labels, width, vecs, low, high in zip(*(common.column_of(batch, c).to_pylist() for c in ("ids", "labels", "width", "vecs", "lows", "highs")), strict=True):
                a = opened(ids, labels, width, vecs, ANCHOR_LEAF)
                search = _search(a, low, high, same, most)
                search.run(known)
                back = np.empty(search.low.shape, "<i8")
                back[a.order] = search.low
                lows.append(back.tobytes())
            yield batch.set_column(batch.schema.get_field_index("lows"), "lows", pa.array(lows, pa.binary()))

    return queries.mapInArrow(bound, queries.schema)


def _search(a: Tree, low: bytes, high: bytes, same: bool, most: int) -> Search:
    low, high = (np.frombuffer(v, "<i8").reshape(len(a.ids), -1)[a.order] for v in (low, high))
    return Search(a, low, high, same, most)


_FOUND = "block bigint, row int, query int, found_id bigint, score bigint"


def search(queries: DataFrame, candidates: DataFrame, sample, same: bool, most: int, parts: int) -> DataFrame:
    """``block, row, query, found_id, score``: the best ``most`` candidates in the window of each anchor's queries."""
    queries = common.staged(first_bounds(queries, sample, same, most), "dual-queries")
    ours = balls(queries.select("part", "block", "ids", "labels", "width", "vecs")).join(queries.select("block", "lows", "highs"), "block")
    ours = ours.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    theirs = balls(candidates).groupBy("part").agg(F.collect_list(F.struct("block", "centre", "radius", "low", "high")).alias("blocks"))  # those of one range partition

    def meet(batches):
        for batch in batches:
            pairs = []
            for mine, centre, radius, low, high, lows, highs, others in zip(*(common.column_of(batch, c).to_pylist() for c in ("block", "centre", "radius", "low", "high", "lows", "highs", "blocks")), strict=True):
                centre, lows, highs = np.frombuffer(centre), np.frombuffer(lows, "<i8"), np.frombuffer(highs, "<i8")
                for other in others:
                    apart = low > other["high"] or other["low"] > high
                    if apart if same else low == high == other["low"] == other["high"]:
                        continue
                    far = np.frombuffer(other["centre"])
                    d = min(len(centre), len(far))
                    least, greatest = interval(centre[:d], np.sqrt(centre @ centre), radius, far[:d], np.sqrt(far @ far), other["radius"])
                    if ((lows <= greatest) & (highs >= least)).any():
                        pairs.append((mine, other["block"]))
            columns = zip(*pairs, strict=True) if pairs else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "candidates"])

    pairs = ours.join(theirs, "part").mapInArrow(meet, "block bigint, candidates bigint").withColumn("turn", F.pmod(F.xxhash64("block"), F.lit(TURNS)))
    pairs = common.staged(pairs, "dual-pairs")
    left = pairs.join(queries.drop("part"), "block")
    right = pairs.select(F.col("candidates").alias("of"), F.col("turn").alias("at")).distinct().join(candidates.select(F.col("block").alias("of"), "ids", "labels", "width", "vecs"), "of")

    def run(_, anchors, blocks):
        out = []
        columns = ("ids", "labels", "width", "vecs")
        for c in blocks.select(columns).to_pylist():
            tree = opened(*c.values(), LEAF)
            for one in anchors.to_pylist():
                a = opened(*(one[k] for k in columns), ANCHOR_LEAF)
                found = _search(a, one["lows"], one["highs"], same, most)
                found.run(tree)
                row, query, rank = np.nonzero(found.scores != _NONE)
                out.append(pa.table({"block": np.full(len(row), one["block"]), "row": a.order[row].astype(np.int32), "query": query.astype(np.int32), "found_id": found.found[row, query, rank], "score": found.scores[row, query, rank]}))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in zip(("block", "row", "query", "found_id", "score"), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

    found = left.groupBy("candidates", "turn").cogroup(right.groupBy("of", "at")).applyInArrow(run, _FOUND)
    best = Window.partitionBy("block", "row", "query").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


# ---- the operator ---------------------------------------------------------------------------------------------------
def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, anchor_step: int = 100, relabel_step: int = 7, labels: int = 10) -> DataFrame:
    """Hard negatives of every anchor and positive, best first."""
    spark = vectors.sparkSession
    rows = common.staged(scaled(vectors, scale, anchor_step, relabel_step, labels).withColumn("spread", F.xxhash64("vec_id", "vec")), "dual-rows")
    size = rows.agg(F.count("*").alias("n"), F.max("dims").alias("dims"), F.sum(F.col("anchor").cast("long")).alias("anchors")).first()
    n, anchors = size["n"], size["anchors"] or 0
    few = rows.orderBy("spread", "vec_id", "label").limit(max(16, SAMPLE_VALUES // max(1, size["dims"] or 1))).dropDuplicates(["vec_id", "label", "vec"]).collect()
    x = matrix([r["vec"] for r in few], [r["dims"] for r in few])
    sample = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in few], np.int64), np.array([r["label"] for r in few], np.int64), x))
    cells = spark.sparkContext.broadcast(fit_cells(x))

    def assign(batches):
        for batch in batches:
            x = matrix(common.column_of(batch, "vec").to_pylist(), common.column_of(batch, "dims").to_pylist())
            cell = np.zeros(len(x), np.int32)
            cells_of(x, cells.value, np.arange(len(x)), cell)
            yield batch.append_column("cell", pa.array(cell))

    rows = common.staged(rows.mapInArrow(assign, "vec_id bigint, label bigint, anchor boolean, dims int, vec binary, spread bigint, cell int"), "dual-cells")
    most = min(BLOCK, max(LEAST_BLOCK, n // 64))
    candidates = blocks(rows, most, max(1, -(-n // (4 * most))), "dual-candidates")
    parts = (candidates.agg(F.max("part")).first()[0] or 0) + 1
    asked = blocks(rows.where("anchor"), ANCHOR_BLOCK, max(1, -(-anchors // (4 * ANCHOR_BLOCK))), "dual-anchors")

    def open_windows(batches):
        for batch in batches:
            n = [len(v) // 8 for v in common.column_of(batch, "ids").to_pylist()]
            for name, end in (("lows", -(1 << 62)), ("highs", 1 << 62)):
                batch = batch.append_column(name, pa.array([np.full(k, end, "<i8").tobytes() for k in n], pa.binary()))
            yield batch

    whole = asked.mapInArrow(open_windows, _BLOCK + ", lows binary, highs binary")
    best = common.staged(search(whole, candidates, sample, True, positives, parts), "dual-positives")

    def score_windows(batches):
        for batch in batches:
            lows, highs = [], []
            for ids, found in zip(common.column_of(batch, "ids").to_pylist(), common.column_of(batch, "found").to_pylist(), strict=True):
                low = np.full((len(ids) // 8, positives), 1 << 62, "<i8")
                high = np.full((len(ids) // 8, positives), -(1 << 62), "<i8")
                for f in found:
                    tens, rest = divmod(f["score"], 100)
                    low[f["row"], f["rank"] - 1] = percent * tens - (-percent * rest // 100)
                    high[f["row"], f["rank"] - 1] = f["score"]
                lows.append(low.tobytes())
                highs.append(high.tobytes())
            out = batch.select([c for c in batch.schema.names if c != "found"])
            yield out.append_column("lows", pa.array(lows, pa.binary())).append_column("highs", pa.array(highs, pa.binary()))

    of_block = best.groupBy("block").agg(F.collect_list(F.struct("row", "rank", "score")).alias("found"))  # those of one block
    windows = asked.join(of_block, "block").select("part", "block", "ids", "labels", "width", "vecs", "found").mapInArrow(score_windows, _BLOCK + ", lows binary, highs binary")
    hard = search(windows, candidates, sample, False, negatives, parts)

    def names(batches):
        for batch in batches:
            block, ids = (common.column_of(batch, c).to_pylist() for c in ("block", "ids"))
            for b, i in zip(block, ids, strict=True):
                i = np.frombuffer(i, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), b)), pa.array(np.arange(len(i), dtype=np.int32)), pa.array(i)], names=["block", "row", "anchor_id"])

    named = best.join(asked.select("block", "ids").mapInArrow(names, "block bigint, row int, anchor_id bigint"), ["block", "row"])
    named = named.select("block", "row", (F.col("rank") - 1).alias("query"), "anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(named, ["block", "row", "query"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
