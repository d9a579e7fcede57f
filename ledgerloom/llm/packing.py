"""Best-fit packing (operator 10) of tokenised documents into sequences of a fixed capacity.

Method: bulk-synchronous best-fit.  Pieces are range-sorted by length on the cluster and numbered within their length.
Lengths are whole numbers up to the capacity, so the open documents and the open gaps of any corpus are two sorted
tables of at most ``capacity`` rows: how many documents of a length, how many sequences with a gap.  A superstep sweeps
the documents of one length to their successor gap, the smallest that holds them; when more documents want gaps than
there are, those of lower rank win and the others sweep on to the next gap or open new sequences; the gaps that took
documents move to their new size; this repeats until no document is open.  Every superstep handles all documents of a
length that meet the same gap at once, which places them exactly as one-at-a-time best-fit-decreasing would.  The
outcome is a table of runs (length, ranks from, ranks to -> sequences from) of a size bounded by the capacity, which the
cluster applies to the ranked pieces.  Counting, ranking and placing grow with the data and are Spark's; the supersteps
hold at most ``capacity`` lengths and gaps whatever the size of the corpus.

Defined results: a null text is an empty text and makes one piece of one (end) token; equal lengths are ranked by range
partition, then by document and piece, so repeated rows are packed like any others; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common, tokens

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every text: the first takes what is over, the others are full."""

    def cut(batches):
        enc = tokens.encoder(tokenizer)
        for batch in batches:
            ids = common.column_of(batch, "doc_id").to_pylist()
            out = [[], [], [], [], []]
            for first, texts in tokens.texts_of(common.column_of(batch, "text")):
                for doc, got in zip(ids[first : first + len(texts)], enc.encode(texts), strict=True):
                    all_ids = np.empty(len(got) + 1, "<u4")
                    all_ids[:-1] = got
                    all_ids[-1] = end_id
                    n = len(all_ids)
                    a = 0
                    for k, b in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                        for column, value in zip(out, (doc, k, a, b - a, zlib.crc32(all_ids[a:b].tobytes())), strict=True):
                            column.append(value)
                        a = b
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", common.text_or_empty().alias("text")).mapInArrow(cut, _PIECES)


def supersteps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, documents per sequence, first sequence, offset) for so many documents of each length.

    A run goes on to the first rank of the next run of its length.
    """
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap -> runs of sequences [first, number]
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for gap in sorted(g for g in gaps if g >= length and gaps[g]):
            each = gap // length
            while left and gaps[gap]:
                block = gaps[gap][-1]
                take = min(block[1], -(-left // each))
                first = block[0] + block[1] - take
                block[1] -= take
                if not block[1]:
                    gaps[gap].pop()
                left -= _fill(runs, gaps, length, rank, left, each, first, take, gap, capacity)
                rank = counts[length] - left
            if not left:
                break
        if left:
            each = capacity // length
            take = -(-left // each)
            _fill(runs, gaps, length, rank, left, each, opened, take, capacity, capacity)
            opened += take
    return runs


def _fill(runs, gaps, length, rank, left, each, first, take, gap, capacity) -> int:
    """Place up to ``each`` documents in each of ``take`` sequences; the last one may get fewer."""
    placed = min(left, take * each)
    runs.append((length, rank, each, first, capacity - gap))
    full, rest = divmod(placed, each)
    if full:
        gaps[gap - each * length].append([first, full])
    if rest:
        gaps[gap - rest * length].append([first + full, 1])
    return placed


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """Give each piece (with ``length`` and a key in ``doc_id, piece``) its sequence and its offset there."""
    spark = cut.sparkSession
    cut = common.staged(cut, "packing-pieces")  # else the range sort's sample would tokenise everything once more
    spread = F.xxhash64("doc_id", "piece")
    ranked = common.staged(
        cut.withColumn("spread", spread).repartitionByRange("length", "spread").sortWithinPartitions("length", "spread").withColumn("part", F.spark_partition_id()),
        "packing-sorted",
    )
    by_part = ranked.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_part.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = common.staged(before, "packing-before")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = sorted(supersteps(counts, capacity))
    length = np.array([r[0] for r in runs], np.int64)
    first_rank = np.array([r[1] for r in runs], np.int64)
    each, sequence, offset = (np.array([r[k] for r in runs], np.int64) for k in (2, 3, 4))
    starts = {r: k for k, r in reversed(list(enumerate(length.tolist())))}
    ends = {r: k + 1 for k, r in enumerate(length.tolist())}
    plan = spark.sparkContext.broadcast((first_rank, each, sequence, offset, starts, ends))  # bounded by the capacity

    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("spread", "doc_id", "piece")) - 1
    numbered = ranked.withColumn("within", within.cast("long")).join(before.select("length", "part", "before"), ["length", "part"])

    def look_up(batches):
        first_rank, each, sequence, offset, starts, ends = plan.value
        for batch in batches:
            size = common.column_of(batch, "length").to_numpy(zero_copy_only=False)
            rank = common.column_of(batch, "rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for one in np.unique(size).tolist():
                rows = np.flatnonzero(size == one)
                a, b = starts[one], ends[one]
                k = a + np.searchsorted(first_rank[a:b], rank[rows], "right") - 1
                nth = rank[rows] - first_rank[k]
                seq[rows] = sequence[k] + nth // each[k]
                off[rows] = offset[k] + nth % each[k] * one
            yield pa.RecordBatch.from_arrays([*(common.column_of(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank")).mapInArrow(look_up, _PIECES + ", sequence_id bigint, offset bigint")


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """All documents in as few sequences as best-fit-decreasing needs; one row for each piece."""
    return place(pieces(docs, capacity, tokenizer, end_id), capacity)
