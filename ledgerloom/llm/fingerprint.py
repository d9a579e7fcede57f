"""Document fingerprints (operator 5): a quartile bucket digest over hashed byte triplets.

Each byte position gives three triplets from the four bytes that start there (1-2-3, 1-2-4, 1-3-4), hashed into
``BUCKETS`` buckets.  The digest holds, for every bucket, which quartile of the document's bucket counts its count lies
in (two bits), and one byte for the logarithm of the length.  The difference of two digests adds, over the buckets, the
distance of the quartiles (a distance of three counts double, as in public locality-sensitive digests) and the distance
of the lengths, each bounded; the likeness is 1 minus the difference over its bound for unrelated texts, not below 0.

To pair each document with its successor, documents are dealt once into ranges of doc_id ("blocks"); the largest document
of each block travels to the block above as a guest too, so that every pair meets in one task.  Blocks are streamed in
descending order, holding one text back.

Defined results: a null text is empty; a text with no triplet has an all-zero digest and its length; rows with the same
doc_id follow each other in the order of their texts; a lone document is its own successor; a null doc_id
comes last; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common

BUCKETS = 128
#: A difference from which texts count as unlike altogether.
UNLIKE = 160

_COST = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])


def triplet_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of hashed triplets, texts x buckets."""
    n = len(at) - 1
    out = np.zeros(n * BUCKETS, np.int64)
    for first, last in common.steps(at):
        part = data[at[first] : at[last]].astype(np.uint32)
        if len(part) < 3:
            continue
        left = np.repeat(at[first + 1 : last + 1] - at[first], np.diff(at[first : last + 1])) - np.arange(len(part))
        owner = np.repeat(np.arange(first, last) * BUCKETS, np.diff(at[first : last + 1]))
        a, b, c = part * np.uint32(0x9E3779B1), part * np.uint32(0x85EBCA77), part * np.uint32(0xC2B2AE3D)
        for x, y, z, span in ((a[:-2], b[1:-1], c[2:], 3), (a[:-3], b[1:-2], c[3:], 4), (a[:-3], b[2:-1], c[3:], 4)):
            h = x + y + z + np.uint32(span * 0x27D4EB2F)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            inside = left[: len(h)] >= span
            key = owner[: len(h)][inside] + (h[inside] >> np.uint32(32 - BUCKETS.bit_length() + 1))
            out += np.bincount(key, minlength=len(out))
            if span == 3 and len(part) < 4:
                break
    return out.reshape(n, BUCKETS)


def digests(counts: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Quartile codes of all buckets and the length byte, texts x (BUCKETS + 1)."""
    ordered = np.sort(counts, 1)
    q = ordered[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    codes = sum((counts > q[:, k : k + 1]).astype(np.uint8) for k in range(3))
    length = np.minimum(255, np.floor(np.log(np.maximum(n_bytes, 1)) / np.log(1.1))).astype(np.uint8)
    return np.c_[codes, length]


def hexed(digest: np.ndarray) -> list[str]:
    quads = digest[:, :BUCKETS].reshape(len(digest), -1, 4)
    packed = quads[:, :, 0] | quads[:, :, 1] << 2 | quads[:, :, 2] << 4 | quads[:, :, 3] << 6
    rows = np.c_[digest[:, BUCKETS], packed].astype(np.uint8)
    return [r.tobytes().hex() for r in rows]


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """From 0 to 1, row by row; 1 for equal digests."""
    body = _COST[one[:, :BUCKETS], other[:, :BUCKETS]].sum(1)
    length = np.minimum(12, np.abs(one[:, BUCKETS].astype(int) - other[:, BUCKETS]) * 2)
    return np.maximum(0.0, 1 - (body + length) / UNLIKE)


def fingerprint(texts: list[str]) -> np.ndarray:
    data = [t.encode() for t in texts]
    at = np.r_[0, np.cumsum([len(x) for x in data], dtype=np.int64)]
    return digests(triplet_counts(np.frombuffer(b"".join(data), np.uint8), at), np.diff(at))


def with_successor(docs: DataFrame) -> DataFrame:
    """``block, guest, doc_id, text``: in each block, sorted by guest, doc_id descending and text, each row that isn't a guest is followed by its successor."""
    spark = docs.sparkSession
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.coalesce("doc_id", F.lit(common.NO_ID)).alias("doc_id"), "text")
    by_range = docs.select("doc_id").repartitionByRange(blocks, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("most"))
    bounds = np.array(sorted(r["most"] for r in by_range.collect()), np.int64)  # one number for each block

    @F.pandas_udf("int")
    def block_of(doc_id: pd.Series) -> pd.Series:
        k = np.searchsorted(bounds, doc_id.to_numpy(np.int64))
        top = bounds[np.minimum(k, len(bounds) - 1)] == doc_id.to_numpy(np.int64)
        return pd.Series(2 * k + top)

    n = len(bounds)
    dealt = docs.select("doc_id", common.text_or_empty().alias("text"), block_of("doc_id").alias("code"))
    own = F.struct((F.col("code") / 2).cast("int").alias("block"), F.lit(False).alias("guest"))
    above = F.struct((((F.col("code") / 2).cast("int") + 1) % F.lit(max(n, 1))).cast("int").alias("block"), F.lit(True).alias("guest"))
    return dealt.select("doc_id", "text", F.explode(F.when(F.col("code") % 2 == 1, F.array(own, above)).otherwise(F.array(own))).alias("to")).select("to.block", "to.guest", "doc_id", "text")


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprint every text, its edited text (its second half replaced by its successor's start) and its successor."""
    met = with_successor(docs).repartition("block").sortWithinPartitions("block", "guest", F.col("doc_id").desc(), "text")

    def work(pairs: list[tuple[int, str, str]]):
        ids, texts, nexts = zip(*pairs, strict=True)
        edited = [t[: len(t) - len(t) // 2] + s[: len(t) // 2] for t, s in zip(texts, nexts, strict=True)]
        own, other, after = fingerprint(list(texts)), fingerprint(edited), fingerprint(list(nexts[-1:]))
        # a pair's successor is mostly the next pair's own text
        follows = np.array([nexts[k] is texts[k + 1] for k in range(len(texts) - 1)] + [False])
        odd = np.flatnonzero(~follows[:-1])
        nxt = np.vstack([own[1:], after])
        if len(odd):
            nxt[odd] = fingerprint([nexts[k] for k in odd])
        return pa.RecordBatch.from_arrays(
            [common.ids_array(ids), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(hexed(own)), pa.array(hexed(other)), pa.array(likeness(own, other)), pa.array(likeness(own, nxt))],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def stream(batches):
        held, pairs, size = None, [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows = batch.slice(first, 512)
                for block, guest, doc, text in zip(*(common.column_of(rows, c).to_pylist() for c in ("block", "guest", "doc_id", "text")), strict=True):
                    if held and held[0] == block and not held[3]:
                        pairs.append((held[1], held[2], text))
                        size += len(text)
                        if size > common.STEP_BYTES:
                            yield work(pairs)
                            pairs, size = [], 0
                    # only the first guest of a block follows its last own row
                    held = (block, doc, text, guest)
        if pairs:
            yield work(pairs)

    return met.mapInArrow(stream, _OUT)
