"""Token-ID output (operator 2): frequency-ranked ids in a byte-aligned variable-length coding.

Format.  Ids are replaced by their rank by corpus frequency (0 is the most frequent; ties by id), so that most need one
byte.  Four values share one control byte: two bits each give the number of bytes, 1 to 4, that the value has in the data
bytes, little-endian.  A block holds whole documents in ascending doc_id order: their ids and token counts, the control
bytes and, apart from them, the data bytes.  Blocks are rows of Parquet files, written by Spark's own committed writer to
any store that Spark reaches; file ``part`` k holds only smaller doc_ids than file k+1.  A second small table holds the
ranks.  Decoding finds value lengths by table lookup on the control bytes, all values of a block at once in numpy.

Defined results: a null text is an empty text and encodes to the end id alone; rows with the same doc_id are kept, in
the order of their ids' number and bytes; a null doc_id comes first and is null again when read;
an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common, tokens

#: A block ends with the document that brings it to so many tokens.
BLOCK_TOKENS = 1 << 18
#: Words remembered by one Python worker while it encodes, some 350 MB.
WORDS_KEPT = 2_000_000

_BLOCK = "part int, block int, doc_ids binary, counts binary, tokens bigint, control binary, data binary"


def raw_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Every document's plain ids, compressed, so that texts are tokenised once; and, as a row with ``n`` of -1 for each task, counts of all ids."""

    def encode(batches):
        enc = tokens.encoder(tokenizer, WORDS_KEPT)
        end = np.array([end_id], enc.dtype).tobytes()
        total = np.zeros(enc.vocabulary, np.int64)
        names = ["doc_id", "n", "ids"]
        for batch in batches:
            for first, texts in tokens.texts_of(common.column_of(batch, "text")):
                got = [ids + end for ids in enc.encode_bytes(texts)]
                total += np.bincount(np.frombuffer(b"".join(got), enc.dtype), minlength=len(total))
                packed = [pa.compress(ids, "zstd", asbytes=True) for ids in got]
                yield pa.RecordBatch.from_arrays([common.column_of(batch, "doc_id").slice(first, len(texts)), pa.array([len(ids) // len(end) for ids in got], pa.int64()), pa.array(packed, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=names)

    return docs.select(F.coalesce("doc_id", F.lit(common.NO_ID)).alias("doc_id"), common.text_or_empty().alias("text")).mapInArrow(encode, "doc_id bigint, n bigint, ids binary")


def _plain(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[np.ndarray]:
    for n, packed in zip(common.column_of(batch, "n").to_pylist(), common.column_of(batch, "ids"), strict=True):
        yield np.frombuffer(pa.decompress(packed.as_buffer(), n * kind.itemsize, "zstd"), kind)


def token_counts(raw: DataFrame) -> DataFrame:
    """How often each id occurs in all documents; one row for each id that does."""

    def add(batches):
        total = 0
        for batch in batches:
            for counts in common.column_of(batch, "ids"):
                total = total + np.frombuffer(counts.as_buffer(), np.int64)
        used = np.flatnonzero(total) if not isinstance(total, int) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used] if len(used) else [], pa.int64())], names=["id", "n"])

    return raw.where("n = -1").select("ids").mapInArrow(add, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def _raw_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def ranks(counts: DataFrame) -> np.ndarray:
    """Ids in order of falling frequency; at most as many as the vocabulary has."""
    rows = counts.collect()  # bounded by the vocabulary
    ids, n = np.array([r["id"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
    return ids[np.lexsort((ids, -n))]


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    n = len(values)
    size = (values > 0xFF).view(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)  # less one
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = size
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    most = int(size.max()) + 1 if n else 1
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :most]
    return control.tobytes(), (raw[np.arange(most) <= size[:, None]] if most > 1 else raw).tobytes()


#: Lengths of the four values that a control byte stands for.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1).astype(np.uint8)


def unpack_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values behind ``pack_values``."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data, np.uint8)
    if not n:
        return np.zeros(0, np.uint32)
    at = np.cumsum(size, dtype=np.int64)
    at -= size
    out = raw[at].astype(np.uint32)
    for k in range(1, int(size.max())):
        longer = np.flatnonzero(size > k)
        out[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Encode all documents into token files under ``path``: ``path/ranks`` and ``path/blocks``."""
    spark = docs.sparkSession
    raw = common.staged(raw_ids(docs, tokenizer, end_id), "tokenfile-raw")
    vocabulary = tokens.vocabulary_size(tokenizer)
    order = ranks(token_counts(raw))
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(len(order)), pa.int32()), "id": pa.array(order, pa.int32())})).coalesce(1).write.parquet(f"{path}/ranks")
    shared = spark.sparkContext.broadcast(order)  # bounded by the vocabulary

    def blocks(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        rank = np.zeros(vocabulary, np.uint32)
        rank[shared.value] = np.arange(len(shared.value))
        ids, sizes, held, total = [], [], [], 0

        def block():
            control, data = pack_values(rank[np.concatenate(held)])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([np.array(sizes, "<i4").tobytes()]), pa.array([total], pa.int64()), pa.array([control]), pa.array([data])],
                names=["part", "block", "doc_ids", "counts", "tokens", "control", "data"],
            )

        for batch in batches:
            for doc, got in zip(common.column_of(batch, "doc_id").to_pylist(), _plain(batch, _raw_type(vocabulary)), strict=True):
                ids.append(doc)
                sizes.append(len(got))
                held.append(got)
                total += len(got)
                if total >= BLOCK_TOKENS:
                    yield block()
                    number += 1
                    ids, sizes, held, total = [], [], [], 0
        if ids:
            yield block()

    in_order = raw.where("n > 0").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n", "ids")
    in_order.mapInArrow(blocks, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: where its ids start, how many they are, and their crc32."""
    order = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast(order)
    files = spark.read.parquet(f"{path}/blocks")
    per_part = files.groupBy("part").agg(F.sum("tokens").alias("n"))
    parts = per_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "block", F.coalesce(F.sum("tokens").over(in_part), F.lit(0)).alias("block_start")).join(F.broadcast(parts), "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("before"))

    def decode(batches):
        order = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], "<i4")
                ids = order[unpack_values(row["control"], row["data"], int(counts.sum()))]
                at = np.r_[0, np.cumsum(counts, dtype=np.int64)]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [common.ids_array(np.frombuffer(row["doc_ids"], "<i8")), pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["block"], np.int32)), pa.array(at[:-1]), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["doc_id", "part", "block", "inside", "n_tokens", "ids_crc32"],
                )

    decoded = files.mapInArrow(decode, "doc_id bigint, part int, block int, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return decoded.join(starts, ["part", "block"]).select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Write the token files to the shared folder and read them back."""
    path = common.scratch_path(docs.sparkSession, "tokenfile")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
