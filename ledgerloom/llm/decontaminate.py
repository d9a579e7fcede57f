"""Benchmark decontamination (operator 4): q-gram lemma filtering, then banded alignment.

Texts and benchmark items are compared as plain letters and digits in lower case with one blank between words.  An item
of n bytes within ``k = budget * n`` edits of a stretch of text shares at least n + 1 - q (k + 1) of its q-grams with it,
all on diagonals (text position less item position) at most k apart.  So the shared q-grams of a document and an item are
counted in diagonal bands of 2k + 1, each overlapping its neighbour by half, and a band is kept only if its count meets
that bound.  What is left is verified by a banded alignment of the item against the stretch: the edit distance of the
whole item to the best-matching part of the stretch.  Items too short for the bound to hold with ``q`` get shorter
q-grams, ``n // (k + 1)``, with which it does; the edit budget is the same for all.

The q-grams of the items are broadcast while they are under ``BROADCAST_BYTES``; a larger benchmark is dealt by a hash of
the item into as many slices as that takes, one scan of the documents for each.

Result: one row for each document and item found: ``doc_id, item_id, start, stop, edits`` (positions in the compared
form of the text).

Defined results: null and empty texts hold no item; items of fewer than ``LEAST`` compared bytes, null ones too, name
nothing in particular and are never found; an item that occurs several times in a document is reported at its best, then leftmost place; rows that repeat
are each reported; items that are equal are each reported; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import common

Q = 8
#: Compared bytes of an item, at least.
LEAST = 8
#: Edits allowed, as a part of the item's length.
BUDGET = 0.1
#: Of item text in a slice that is broadcast at once.
BROADCAST_BYTES = 4 << 20
#: Shared q-grams that are counted at once; the items are taken in turns where a stretch of documents has more.
HITS = 1 << 22

_PLAIN = np.full(256, 32, np.uint8)
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalnum() or _c >= 0x80:
        _PLAIN[_c] = _c


def compared_form(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters and digits with one blank between words, document by document."""
    plain = _PLAIN[common.folded(data)]
    blank = plain == 32
    edge = np.zeros(len(plain) + 1, bool)
    edge[at] = True
    keep = ~blank
    if len(plain):
        keep[1:] |= blank[1:] & ~blank[:-1] & ~edge[1:-1]
    moved = np.r_[0, np.cumsum(keep)]
    return plain[keep], moved[at]


def thresholds(n: int, budget: float = BUDGET, q: int = Q) -> tuple[int, int, int]:
    """Edits allowed, length of the q-grams and shared q-grams required for an item of ``n`` bytes."""
    k = int(budget * n)
    q = min(q, n // (k + 1))
    return k, q, n + 1 - q * (k + 1)


class Items:
    """Benchmark items of one q-gram length in compared form, with their q-grams sorted by hash."""

    def __init__(self, q: int, ids: list[int], texts: list[np.ndarray], limits: list[tuple[int, int, int]]):
        self.q, self.ids, self.text = q, ids, texts
        grams = [common.window_hash(common.prefix_hash(t), q) for t in texts]
        self.edits = np.array([k for k, _, _ in limits], np.int64)
        self.needed = np.array([m for *_, m in limits], np.int64)
        self.grams = np.concatenate(grams)
        order = np.argsort(self.grams, kind="stable")
        self.grams = self.grams[order]
        self.owner = np.repeat(np.arange(len(ids)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order]
        self.bits = max(16, int(len(self.grams) * 32).bit_length())
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self.grams >> np.uint64(64 - self.bits)] = True

    def hits(self, data: np.ndarray):
        """Text position, item and item position of every shared q-gram, the items in turns of at most about ``HITS``."""
        if len(data) < self.q:
            return
        h = common.window_hash(common.prefix_hash(data), self.q)
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - self.bits)])
        lo, hi = (np.searchsorted(self.grams, h[at], side) for side in ("left", "right"))
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        turns = 1 + int(n.sum()) // HITS
        for turn in range(turns):
            parts = [(np.zeros(0, np.int64),) * 3]
            for a in range(0, len(n), HITS):  # few positions can have many hits, many have few
                some = n[a : a + HITS]
                ends = np.cumsum(some)
                cuts = np.searchsorted(ends, np.arange(1, int(ends[-1]) // HITS + 1) * HITS, "left") + 1 if turns > 1 else []
                for b, c in zip([0, *cuts], [*cuts, len(some)], strict=True):
                    if c > b:
                        m = some[b:c]
                        k = np.repeat(lo[a + b : a + c] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
                        place = np.repeat(at[a + b : a + c], m)
                        mine = self.owner[k] % turns == turn
                        parts.append((place[mine], self.owner[k][mine], self.place[k][mine]))
            yield tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def item_sets(ids: list[int], texts: list[str], budget: float, q: int) -> list[Items]:
    """The items in compared form, by the length of their q-grams."""
    by_q: dict[int, tuple[list, list, list]] = {}
    for item, text in zip(ids, texts, strict=True):
        data = np.frombuffer((text or "").encode(), np.uint8)
        data, _ = compared_form(data, np.array([0, len(data)]))
        data = data[: len(data) - (len(data) > 0 and data[-1] == 32)]
        if len(data) >= LEAST:
            limits = thresholds(len(data), budget, q)
            for column, value in zip(by_q.setdefault(limits[1], ([], [], [])), (item, data, limits), strict=True):
                column.append(value)
    return [Items(k, *columns) for k, columns in sorted(by_q.items())]


def align(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """Least edits that turn the item into a part of the text, and that part, if at most ``most``.

    One row of the alignment for each byte of the item; insertions within a row come from a running minimum.
    """
    n = len(text)
    j = np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), j.copy()
    for i, c in enumerate(item, 1):
        up = row + 1
        across = np.empty(n + 1, np.int64)
        across[0] = i
        across[1:] = row[:-1] + (text != c)
        best = np.minimum(up, across)
        origin = np.where(across < up, np.r_[0, start[:-1]], start)
        origin[0] = 0
        packed = (best - j) * (n + 2) - origin  # of equal costs, the one that starts last
        least = np.minimum.accumulate(packed)
        run = -(-least // (n + 2))
        origin = run * (n + 2) - least
        row, start = run + j, origin
        if row.min() > most:
            return None
    end = int(row.argmin())
    return int(row[end]), int(start[end]), end


def _bands(items: Items, at: np.ndarray, doc: np.ndarray, item: np.ndarray, place: np.ndarray):
    """Kept bands, by document, item and position: document, item and the band's first diagonal."""
    reach = items.edits[item] + 1
    band = np.floor_divide(at - place, reach)
    if not len(band):
        return
    # most bands hold too few q-grams even with repeats, which one sort of numbers shows
    low, count_items = band.min() - 1, len(items.ids)
    span = band.max() - low + 1
    number = (doc * count_items + item) * span + band - low
    every = np.sort(np.r_[number, number - 1])
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    enough = every[first][np.diff(np.r_[first, len(every)]) >= items.needed[every[first] // span % count_items]]
    keep = np.isin(number, enough) | np.isin(number - 1, enough)
    doc, item, place, band = doc[keep], item[keep], place[keep], band[keep]
    # band b spans the diagonals [b * reach, (b + 2) * reach): each q-gram counts in two bands
    d, i, b, p = np.tile(doc, 2), np.tile(item, 2), np.r_[band, band - 1], np.tile(place, 2)
    order = np.lexsort((p, b, i, d))
    d, i, b, p = d[order], i[order], b[order], p[order]
    if not len(d):
        return
    group = np.r_[True, (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])]
    first = np.flatnonzero(group)
    new = group | np.r_[True, p[1:] != p[:-1]]  # a q-gram of the item counts once
    count = np.add.reduceat(new.astype(np.int64), first)
    for k in first[count >= items.needed[i[first]]].tolist():
        yield int(d[k]), int(i[k]), int(b[k] * (items.edits[i[k]] + 1))


def verify(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """``align``, after a look for the item as it is."""
    exact = text.tobytes().find(item.tobytes())
    return (0, exact, exact + len(item)) if exact >= 0 else align(item, text, most)


def found_in(sets: list[Items], data: np.ndarray, at: np.ndarray):
    """Document, item, start, stop and edits of each item found in some documents."""
    for first, last in common.steps(at):
        part, begin = compared_form(data[at[first] : at[last]], at[first : last + 1] - at[first])
        for items in sets:
            for place, item, item_place in items.hits(part):
                doc = np.searchsorted(begin, place, "right") - 1
                inside = place + items.q <= begin[doc + 1]
                place, item, item_place, doc = place[inside], item[inside], item_place[inside], doc[inside]
                for (d, i), (edits, start, stop) in _best(items, part, begin, place, doc, item, item_place).items():
                    yield first + d, items.ids[i], start, stop, edits


def _best(items: Items, part: np.ndarray, begin: np.ndarray, place: np.ndarray, doc: np.ndarray, item: np.ndarray, item_place: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """Of each document and item with a band that verifies: the least edits, and the leftmost place that needs them."""
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for d, i, diagonal in _bands(items, place - begin[doc], doc, item, item_place):
        if best.get((d, i), (1,))[0] == 0:
            continue
        k, n = int(items.edits[i]), len(items.text[i])
        a, b = max(0, diagonal - k), min(int(begin[d + 1] - begin[d]), diagonal + 2 * (k + 1) + n + k)
        got = verify(items.text[i], part[begin[d] + a : begin[d] + b], k)
        if got and (got[0], a + got[1], a + got[2]) < best.get((d, i), (1 << 30,)):
            best[d, i] = (got[0], a + got[1], a + got[2])
    return best


def _slices(benchmark: DataFrame, budget: float, q: int):
    """The items in broadcast parts of about ``BROADCAST_BYTES``."""
    context = benchmark.sparkSession.sparkContext
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).collect()[0]["b"]
    slices = max(1, -(-size // BROADCAST_BYTES))
    for k in range(slices):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).select("item_id", "text").collect()
        rows = sorted((r["item_id"] is not None, r["item_id"] or 0, r["text"] or "") for r in rows)
        yield context.broadcast(([r[1] if r[0] else None for r in rows], [r[2] for r in rows], budget, q))


def find(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, q: int = Q) -> DataFrame:
    """``doc_id, item_id, start, stop, edits`` for every benchmark item in a document."""

    def scan(shared):
        def work(batches):
            items = item_sets(*shared.value)
            for batch in batches:
                out = list(found_in(items, *common.utf8(common.column_of(batch, "text"))))
                cols = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
                yield pa.RecordBatch.from_arrays([common.column_of(batch, "doc_id").take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "item_id", "start", "stop", "edits"])

        return docs.select("doc_id", common.text_or_empty().alias("text")).mapInArrow(work, "doc_id bigint, item_id bigint, start bigint, stop bigint, edits bigint")

    return functools.reduce(DataFrame.unionByName, map(scan, _slices(benchmark, budget, q)))


def clean(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, q: int = Q) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns."""

    def holds(shared):
        @F.arrow_udf(returnType=T.BooleanType())
        def hit(text: pa.Array) -> pa.Array:
            if shared not in _built:
                _built.clear()
                _built[shared] = item_sets(*shared.value)
            out = np.zeros(len(text), bool)
            out[[d for d, *_ in found_in(_built[shared], *common.utf8(text))]] = True
            return pa.array(out)

        return hit(common.text_or_empty())

    _built: dict = {}
    for shared in _slices(benchmark, budget, q):
        docs = docs.where(~holds(shared))
    return docs
