"""Packing (operator 11) of tokenised documents into windows of nearly equal length by multiway differencing.

Method: Karmarkar-Karp.  A document gives as many whole windows as it fills; what is over is cut at ``capacity / 4``
tokens, so that a window holds a few pieces and their sums can be evened out.  These pieces are dealt into groups of
about ``GROUP`` by a hash of their row, each a task's work of bounded size.  In a group with ``k`` windows a partial
partition is ``k`` sums.  The two partial partitions with the largest imbalance (largest less smallest sum) are merged,
the largest sum of the one with the smallest of the other and so on, until one is left; a single piece is a partial
partition with one sum.  ``k`` begins at the least number that could hold the tokens and rises as long as a window exceeds
the capacity.

Defined results: a null text is an empty text and gives one piece, its end token; repeated rows are packed like others;
an empty table gives no rows; extra columns are ignored.  Pieces are numbered by row in the staged table, so a lost
executor's work is redone with the same outcome.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common, tokens

#: Pieces of a group, on average.
GROUP = 8192
#: Words that a worker remembers, as in operator 2: some 370 MB.
WORDS_KEPT = 2_000_000

_FIELDS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}
_PIECES = ", ".join(f"{name} bigint" for name in _FIELDS)


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1) -> DataFrame:
    """Whole windows of every document, and the rest of it in pieces of at most a quarter of a window."""

    def cut(batches):
        enc = tokens.encoder(tokenizer, WORDS_KEPT)
        for batch in batches:
            ids = common.column_of(batch, "doc_id").to_pylist()
            out: list[tuple] = []
            for first, texts in tokens.texts_of(common.column_of(batch, "text")):
                for doc, got in zip(ids[first : first + len(texts)], enc.encode(texts), strict=True):
                    all_ids = np.empty(len(got) + 1, "<u4")
                    all_ids[:-1] = got
                    all_ids[-1] = end_id
                    n = len(all_ids)
                    whole = n // capacity * capacity
                    at = [*range(0, whole, capacity), *range(whole, n, max(1, capacity // 4)), n]
                    out += [(doc, a, b - a, zlib.crc32(all_ids[a:b]), n) for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = zip(*out, strict=True) if out else [[]] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FIELDS.values(), strict=True)], names=list(_FIELDS))

    return docs.select("doc_id", common.text_or_empty().alias("text")).mapInArrow(cut, _PIECES)


class Partial:
    """A partial partition: sums of its windows, largest first, and each window's first and last piece; the rest are empty."""

    def __init__(self, sums: np.ndarray, head: np.ndarray, tail: np.ndarray, k: int):
        self.sums, self.head, self.tail = sums, head, tail
        self.imbalance = int(sums[0] - sums[-1]) if len(sums) == k else int(sums[0])


def _with_pieces(one: Partial, sizes: np.ndarray, pieces: np.ndarray, following: np.ndarray, k: int) -> Partial:
    """A partial partition and single pieces, none larger than any before: in empty windows, or one on the smallest sum."""
    if len(one.sums) < k:
        return Partial(np.r_[one.sums, sizes], np.r_[one.head, pieces], np.r_[one.tail, pieces], k)
    total, head = one.sums[-1] + sizes[0], one.head[-1]
    following[one.tail[-1]] = pieces[0]
    to = k - 1 - int(np.searchsorted(one.sums[-2::-1], total)) if k > 1 else 0
    for column, value in ((one.sums, total), (one.head, head), (one.tail, pieces[0])):
        column[to + 1 :] = column[to:-1]
        column[to] = value
    return Partial(one.sums, one.head, one.tail, k)


def _against(one: Partial, other: Partial, following: np.ndarray, k: int) -> Partial:
    """Both, with the largest sums of the one on the smallest of the other."""
    mine, theirs = len(one.sums), len(other.sums)
    met = max(0, mine + theirs - k)
    free = k - theirs if met else mine  # windows of the one that meet none of the other
    rest = theirs - met
    back = slice(None, rest - 1 if rest else None, -1)  # those of the other that meet, smallest first
    following[one.tail[free:]] = other.head[back] if met else other.head[:0]
    sums = np.r_[one.sums[:free], one.sums[free:] + (other.sums[back] if met else 0), other.sums[:rest]]
    head = np.r_[one.head, other.head[:rest]]
    tail = np.r_[one.tail[:free], other.tail[back] if met else other.tail[:0], other.tail[:rest]]
    order = np.argsort(-sums, kind="stable")
    return Partial(sums[order], head[order], tail[order], k)


def difference(sizes: np.ndarray, k: int) -> tuple[Partial, np.ndarray]:
    """The sizes in ``k`` windows by multiway differencing, and for each piece the next one in its window (-1: none)."""
    order = np.argsort(-sizes, kind="stable")
    lengths = sizes[order]
    following = np.full(len(sizes), -1, np.int64)
    held: list[tuple[int, int, Partial]] = []
    at = made = 0
    while True:
        if at < len(order) and (not held or lengths[at] > -held[0][0]):
            first = Partial(lengths[at : at + 1].copy(), order[at : at + 1].copy(), order[at : at + 1].copy(), k)
            at += 1
        else:
            first = heapq.heappop(held)[2]
        second = -held[0][0] if held else -1
        if at < len(order) and lengths[at] >= second:
            # while a window is empty the imbalance is the largest sum, so all pieces that come before ``second`` follow
            most = max(1, min(k - len(first.sums), int(np.searchsorted(-lengths, -second, "right")) - at))
            first = _with_pieces(first, lengths[at : at + most], order[at : at + most], following, k)
            at += most
        elif held:
            first = _against(first, heapq.heappop(held)[2], following, k)
        else:
            return first, following
        made += 1
        heapq.heappush(held, (-first.imbalance, made, first))


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset there of each piece; no piece may exceed the capacity."""
    window, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return window, offset
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found, following = difference(sizes, k)
        over = int(np.maximum(found.sums - capacity, 0).sum())
        if not over:
            break
        k += max(1, over // capacity)
    slot, piece, at = np.arange(len(found.head)), found.head, np.zeros(len(found.head), np.int64)
    while len(piece):
        window[piece], offset[piece] = slot, at
        at = at + sizes[piece]
        piece = following[piece]
        more = piece >= 0
        slot, piece, at = slot[more], piece[more], at[more]
    return window, offset


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1) -> DataFrame:
    """All documents in windows of nearly equal length, one row for each piece."""
    cut = common.staged(pieces(docs, capacity, tokenizer, end_id).withColumn("row", F.monotonically_increasing_id()), "differencing-pieces")
    groups = max(1, round(cut.count() / GROUP))

    def place(key, table):
        table = table.combine_chunks().sort_by("row")
        size = table.column("length").to_numpy()
        window, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        rest = np.flatnonzero(size < capacity)
        window[rest], offset[rest] = windows(size[rest], capacity)
        used = int(window[rest].max()) + 1 if len(rest) else 0
        full = np.flatnonzero(size >= capacity)
        window[full] = used + np.arange(len(full))
        own = (int(key[0].as_py()) << 32) + window
        return table.select(list(_FIELDS)).append_column("sequence_id", pa.array(own)).append_column("offset", pa.array(offset))

    return cut.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("group").applyInArrow(place, _PIECES + ", sequence_id bigint, offset bigint")
