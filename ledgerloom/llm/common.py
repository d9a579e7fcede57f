"""Helpers shared by the corpus operators: scratch tables, Arrow text access and rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import discard, documents, scratch_path, staged  # noqa: F401

#: Bytes of text that one numpy step works on; a longer document is worked on alone.
STEP_BYTES = 1 << 19

#: Stands for a null doc_id where ids are sorted or packed.
NO_ID = -(1 << 63)


def ids_array(ids) -> pa.Array:
    """Document ids as a column, ``NO_ID`` as null."""
    values = np.asarray(ids, np.int64)
    return pa.array(values, mask=values == NO_ID)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column, end to end, and where each begins (one more entry at the end)."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def steps(at: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of up to ``most`` bytes in all; one longer document makes a range of its own."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


# ---- rolling hashes -------------------------------------------------------------------------------------------------
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, base, np.uint64)])
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums of a byte array, for ``span_hash``."""
    up, _ = _powers_to(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), the same for the same bytes wherever they stand."""
    _, down = _powers_to(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start])


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """``span_hash`` of every window of ``width`` bytes, by its start."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = _powers_to(len(prefix))
    return mixed((prefix[width:] - prefix[:n]) * down[:n])


# ---- words ----------------------------------------------------------------------------------------------------------
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters in UTF-8 bytes."""
    out = _FOLD[data]
    if len(out) > 1:
        tail = out[1:]
        up = (data[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
        tail[up] += 0x20
    return out


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs without white space, never across documents, and each document's first word."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, at)


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with the same keys from a partition sorted by them, one table for each key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = column_of(batch, k)
            if batch.num_rows > 1:
                change[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False), bool)
        first = tuple(column_of(batch, k)[0].as_py() for k in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(column_of(batch, k)[batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of complete groups from a partition sorted by ``keys``; several small groups come together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        if n > 1:
            for k in keys:
                c = column_of(batch, k)
                change[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False), bool)
        change[0] = bool(held) and tuple(column_of(batch, k)[0].as_py() for k in keys) != last
        cuts = np.flatnonzero(change)
        last = tuple(column_of(batch, k)[n - 1].as_py() for k in keys)
        if len(cuts):
            cut = int(cuts[-1])
            held.append(batch.slice(0, cut))
            ready = pa.Table.from_batches(held)
            if ready.num_rows:
                yield ready
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def one_chunk(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name).combine_chunks()
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
