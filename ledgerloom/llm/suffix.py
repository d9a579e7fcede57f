"""Suffix-array dedup (operator 7): a logarithmic family of sorted suffix indexes finds long repeated byte strings.

Which suffixes.  Of every string of ``width`` bytes, the anchor is the start of its ``gram``-byte substring with the
least hash (the leftmost of equals).  Equal strings have their anchor at the same place, so it is enough to index the
suffixes at anchors, about 2 in ``width - gram + 2`` positions, to miss no repeat.  An index entry is the hash of the
``gram`` bytes at the anchor (``key``) and the hash of the whole region that the strings with this anchor cover
(``region``).

Index family.  Documents come in batches.  Each batch's entries are sorted into a suffix array of its own, merge-scanned
by key against every level of the family for entries seen before, and then put in as a level; when the next batch comes,
levels of equal size are merged into one of double size, so there are never more than log2(batches) + 1 of them, and an
entry is rewritten that often at most.  Scans yield the keys and the regions that occur more than once.

Judgement.  A region that occurs twice is repeated in whole.  Where only the key does (near the edge of a repeated
passage), ``PROBES`` shorter strings around the anchor, one of which lies in any string of ``width`` bytes, tell whether
a repeat is possible.  If so, the region's strings are compared one by one: their hashes meet by key, those of very
frequent keys dealt further by hash.  Of these a task first settles what repeats among its own and deals one of each, so
that a passage in very many documents comes to its group once from a task, not once from a document.  Last, each document drops the bytes that repeated
strings cover; ``text`` is what is left of it, without the parts of characters that a removed run cuts through.

Defined results: a null text is empty; texts under ``width`` bytes stay whole; rows that repeat in full remove each
other's text; matches don't cross documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common

WIDTH = 400
#: Regions of one key that are compared in one group; more are dealt by the hashes of their strings.
GROUP_REGIONS = 256

#: Strings of frequent keys that a task compares among themselves before it deals them.
HELD_STRINGS = 1 << 18

#: Strings around an anchor that are looked up before the region's own are compared.
PROBES = 4

_ANCHORS = "row_key bigint, start int, n int, key bigint, region bigint, probes array<int>"


def anchors(data: np.ndarray, at: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document, first string's start, number of strings, key, region and probes of each anchor of some documents."""
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2 + (np.zeros((0, PROBES), np.int64),)
    n = len(data)
    if n < width:
        return none
    prefix = common.prefix_hash(data)
    h = common.window_hash(prefix, gram)
    reach = width - gram + 1
    bits = max(1, int(n).bit_length())
    packed = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
    pad = np.full(-len(packed) % reach, np.iinfo(np.uint64).max, np.uint64)
    square = np.concatenate([packed, pad]).reshape(-1, reach)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    least = np.minimum(behind[:m], ahead[reach - 1 : reach - 1 + m])
    anchor = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    room = np.zeros(m + 1, np.int64)
    lengths = np.diff(at)
    long = np.flatnonzero(lengths >= width)
    np.add.at(room, at[long], 1)
    np.add.at(room, np.minimum(at[long] + lengths[long] - width + 1, m), -1)
    valid = np.flatnonzero(np.cumsum(room[:m]) > 0)
    if not len(valid):
        return none
    own = anchor[valid]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    a = valid[first]
    b = valid[np.r_[first[1:], len(valid)] - 1]
    q = own[first]
    region = common.mixed(common.span_hash(prefix, a, b + width) + (q - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    doc = np.searchsorted(at, a, "right") - 1
    # the strings that start step * j before the anchor or up to step - 1 earlier all hold the probe j
    step = -(-reach // PROBES)
    probes = np.zeros((len(q), PROBES), np.int64)
    for j in range(PROBES):
        s = q - step * j
        some = np.flatnonzero((s >= a) & (s - step < b))  # a string of this kind may start in [a, b]
        probes[some, j] = common.span_hash(prefix, s[some], s[some] + width - step + 1).view(np.int64) >> 32 | 1
    return doc, a - at[doc], b - a + 1, h[q], region, probes


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a key of the whole row; rows that repeat in full share it, and what holds for one holds for all."""
    return docs.select("doc_id", common.text_or_empty().alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))


def anchor_table(keyed: DataFrame, width: int, gram: int) -> DataFrame:
    """A row for each anchor of each document."""

    def find(batches):
        for batch in batches:
            keys = common.column_of(batch, "row_key")
            data, at = common.utf8(common.column_of(batch, "text"))
            for first, last in common.steps(at):
                doc, start, n, key, region, probes = anchors(data[at[first] : at[last]], at[first : last + 1] - at[first], width, gram)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(doc) + 1, dtype=np.int32) * PROBES), pa.array(probes.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(doc + first)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(region.view(np.int64)), lists],
                    names=["row_key", "start", "n", "key", "region", "probes"],
                )

    return keyed.select("row_key", "text").mapInArrow(find, _ANCHORS)


class IndexFamily:
    """Levels of (key, region) entries sorted by key; the batches in a level number a power of two."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, DataFrame]] = []
        self.repeated: list[DataFrame] = []

    def add(self, entries: DataFrame) -> None:
        """Scan a batch (``key, region, row_key``, a row for each anchor) against all levels, then take it in as a level."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one), (_, other) = self.levels.pop(), self.levels.pop()
            both = one.unionByName(other).groupBy("key", "region").agg(F.sum("n").alias("n"), F.min("speaker").alias("speaker")).sortWithinPartitions("key")
            self.levels.append((2 * size, common.staged(both, "suffix-level")))
            common.discard(one)
            common.discard(other)
        batch = common.staged(entries.groupBy("key", "region").agg(F.count("*").alias("n"), F.min("row_key").alias("speaker")).sortWithinPartitions("key"), "suffix-level")
        merged = batch.withColumn("new", F.lit(True))
        for _, level in self.levels:
            merged = merged.unionByName(level.withColumn("new", F.lit(False)))
        by_region = merged.repartition("key").groupBy("key", "region").agg(F.sum("n").alias("n"), F.min("speaker").alias("speaker"), F.max("new").alias("new"))
        of_key = Window.partitionBy("key")
        seen = by_region.select(
            "key", "region", F.when((F.col("n") > 1) & F.col("new"), F.col("speaker")).alias("speaker"),
            F.count("*").over(of_key).alias("regions"), F.sum("n").over(of_key).alias("entries"), F.max("new").over(of_key).alias("fresh"), F.min("region").over(of_key).alias("least"),
        )
        # a row for each region that occurs twice, and one for the key
        repeated = seen.where((F.col("entries") > 1) & F.col("fresh") & (F.col("speaker").isNotNull() | (F.col("region") == F.col("least"))))
        self.repeated.append(common.staged(repeated.select("key", "regions", "region", "speaker"), "suffix-repeated"))
        self.levels.append((1, batch))

    def found(self) -> tuple[DataFrame, DataFrame]:
        """Keys that occur more than once, with the number of their regions, and regions that do, with a document that has each."""
        every = self.repeated[0]
        for more in self.repeated[1:]:
            every = every.unionByName(more)
        keys = every.groupBy("key").agg(F.max("regions").alias("regions"))
        regions = every.where("speaker is not null").groupBy("key", "region").agg(F.min("speaker").alias("speaker"))
        # as tables, so that a join with them can split the rows of a frequent key
        return common.staged(keys, "suffix-keys"), common.staged(regions, "suffix-regions")


_DONE = "doc_id bigint, row_key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string"
_OUT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
_MARKS = "array<struct<start:int,n:int,key:bigint,regions:int>>"


def _cut(data: np.ndarray, start: np.ndarray, n: np.ndarray, width: int) -> tuple[int, int, str, str]:
    """Bytes removed, runs removed, the digest of the rest and its whole characters, for strings that start in [start, start + n)."""
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + n - 1 + width, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
    rest = data[~gone].tobytes()
    return int(gone.sum()), runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int | None = None, batches: int = 4) -> DataFrame:
    """Per document: its bytes, bytes and runs that repeated strings of ``width`` bytes cover, the digest of the rest, and the rest as text."""
    gram = gram or width * 3 // 10
    keyed = _keyed(docs)
    found = common.staged(anchor_table(keyed, width, gram).withColumn("batch", F.pmod("row_key", F.lit(batches)).cast("int")), "suffix-anchors")
    family = IndexFamily(docs.sparkSession)
    for k in range(batches):
        family.add(found.where(F.col("batch") == k).select("key", "region", "row_key"))
    for _, level in family.levels:
        common.discard(level)
    keys, regions = family.found()

    again = found.drop("batch").join(keys, "key").join(regions, ["key", "region"], "left")
    again = common.staged(again, "suffix-again")
    common.discard(found)
    # of each region one document speaks for all: probes that occur in two regions of a key
    speaking = again.where((F.col("regions") > 1) & (F.col("speaker").isNull() | (F.col("row_key") == F.col("speaker"))))
    probes = speaking.select("key", "region", F.posexplode("probes").alias("j", "probe")).where("probe != 0")
    live = probes.groupBy("key", "j", "probe").agg(F.min("region").alias("a"), F.max("region").alias("b")).where("a != b").select("key", "j", "probe")
    live = common.staged(live, "suffix-live")  # as a table, so that the join can split the rows of a frequent probe
    open_regions = probes.join(live, ["key", "j", "probe"]).groupBy("key", "region").agg(F.lit(True).alias("open"))
    open_regions = common.staged(open_regions, "suffix-open")
    # 0: settled; above 0: to be compared with so many regions; below 0: settled, but the one that others are compared with
    mark = F.when(F.col("speaker").isNull(), F.col("regions")).when(F.col("row_key") == F.col("speaker"), -F.col("regions")).otherwise(0)
    mark = F.when(F.col("open"), mark).when(F.col("speaker").isNotNull(), 0)  # null: not repeated
    judged = again.drop("probes").join(open_regions, ["key", "region"], "left").withColumn("mark", mark.cast("int")).where("mark is not null")
    marks = judged.groupBy("row_key").agg(F.collect_set(F.struct("start", "n", "key", F.col("mark").alias("regions"))).alias("marks"))

    def first_cut(rows):
        for batch in rows:
            ids, row_keys, texts, all_marks = (common.column_of(batch, c) for c in ("doc_id", "row_key", "text", "marks"))
            out = [[], [], [], [], [], []]
            for text, own in zip(texts.to_pylist(), all_marks.to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                if any(m["regions"] for m in own or ()):
                    result = (len(data), None, None, None, text, own)
                else:
                    sure = np.array([(m["start"], m["n"]) for m in own or ()], np.int64).reshape(-1, 2)
                    result = (len(data), *_cut(data, sure[:, 0], sure[:, 1], width), None)
                for column, value in zip(out, result, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), all_marks.type)
            yield pa.RecordBatch.from_arrays([ids, row_keys, *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["doc_id", "row_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "marks"])

    halfway = common.staged(keyed.join(marks, "row_key", "left").select("doc_id", "row_key", "text", "marks").mapInArrow(first_cut, f"{_DONE}, marks {_MARKS}"), "suffix-halfway")
    open_ = halfway.where(F.col("marks").isNotNull()).select("doc_id", "row_key", "text", "marks")
    spans = _partial(open_.select("row_key", "text", "marks"), width).groupBy("row_key").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def last_cut(rows):
        for batch in rows:
            ids, row_keys, texts, all_marks, found = (common.column_of(batch, c) for c in ("doc_id", "row_key", "text", "marks", "spans"))
            out = [[], [], [], [], []]
            for text, own, more in zip(texts.to_pylist(), all_marks.to_pylist(), found.to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                pairs = [(m["start"], m["n"]) for m in own if m["regions"] <= 0] + [(m["start"], m["n"]) for m in more or ()]
                pairs = np.array(pairs, np.int64).reshape(-1, 2)
                for column, value in zip(out, (len(data), *_cut(data, pairs[:, 0], pairs[:, 1], width)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([ids, row_keys, *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "row_key", *_OUT[1:]])

    rest = open_.join(spans, "row_key", "left").select("doc_id", "row_key", "text", "marks", "spans").mapInArrow(last_cut, _DONE)
    return halfway.where(F.col("marks").isNull()).select(*_OUT).unionByName(rest.select(*_OUT))


def _runs(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of strings that follow each other in one row begin, and their lengths."""
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
    return first, np.diff(np.r_[first, len(at)])


def _partial(open_: DataFrame, width: int) -> DataFrame:
    """``row_key, spans`` of strings in unsettled regions that occur elsewhere with the same key.

    A dealt row has strings of one key and salt: ``at`` and ``hashes``, with the key of the row that all are from, or of
    each string's, in ``owners``.  Salt -1 stands for settled runs of one row: where they start, and their lengths.
    """
    names = ["key", "salt", "owners", "at", "hashes"]

    def strings(rows):
        frequent, held = [], 0
        for batch in rows:
            row_keys = common.column_of(batch, "row_key").to_numpy()
            out = {name: [] for name in names}
            for row_key, text, own in zip(row_keys, common.column_of(batch, "text").to_pylist(), common.column_of(batch, "marks").to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                prefix = common.prefix_hash(data)
                for m in own:
                    if not m["regions"]:
                        continue
                    at = np.arange(m["start"], m["start"] + m["n"])
                    h = common.span_hash(prefix, at, at + width)
                    salts = 1 + (abs(m["regions"]) - 1) // GROUP_REGIONS
                    if salts > 1:
                        frequent.append((m["key"], salts, row_key, at, h))
                        held += len(at)
                        if held >= HELD_STRINGS:
                            yield _batch(_combined(frequent))
                            frequent, held = [], 0
                    else:
                        for name, value in zip(names, (m["key"], 0, row_key.tobytes(), at.astype("<i4").tobytes(), h.tobytes()), strict=True):
                            out[name].append(value)
                if len(out["key"]) >= 2000:
                    yield _batch(out)
                    out = {name: [] for name in names}
            if out["key"]:
                yield _batch(out)
        if frequent:
            yield _batch(_combined(frequent))

    def _combined(frequent):
        n = np.array([len(x[3]) for x in frequent])
        key, salts, owner = (np.repeat(np.array([x[k] for x in frequent], np.int64), n) for k in range(3))
        at, h = (np.concatenate([x[k] for x in frequent]) for k in (3, 4))
        _, one, which, times = np.unique(_met(key, h), return_index=True, return_inverse=True, return_counts=True)
        salt = (h >> np.uint64(40)).astype(np.int64) % salts
        one = np.sort(one)
        one = one[np.lexsort((salt[one], key[one]))]
        k, t = key[one], salt[one]
        cuts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1]), True])
        dealt = [(int(key[i[0]]), int(salt[i[0]]), owner[i], at[i], h[i]) for i in (one[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
        hit = np.flatnonzero(times[which] > 1)
        if len(hit):
            first, length = _runs(owner[hit], at[hit])
            whose, start = owner[hit][first], at[hit][first]
            cuts = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1], True])
            dealt += [(int(whose[a]), -1, whose[a : a + 1], start[a:b], length[a:b].astype(np.uint64)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return dict(zip(names, map(list, zip(*((k, s, o.tobytes(), p.astype("<i4").tobytes(), x.tobytes()) for k, s, o, p, x in dealt), strict=True)), strict=True))

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(out[name], t) for name, t in zip(names, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)

    def _met(key, h):
        return common.mixed(h ^ key.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def repeats(rows):
        for table in common.whole_groups(rows, ["key", "salt"]):
            (owners, whose), (at_bytes, sizes), (hashes, _) = (common.utf8(common.one_chunk(table, c)) for c in ("owners", "at", "hashes"))
            n, of = np.diff(sizes) // 4, np.diff(whose) // 8
            owner = np.repeat(np.frombuffer(owners.tobytes(), np.int64), np.repeat(np.where(of == 1, n, 1), of))
            at, h = np.frombuffer(at_bytes.tobytes(), "<i4"), np.frombuffer(hashes.tobytes(), np.uint64)
            settled = np.repeat(common.one_chunk(table, "salt").to_numpy() < 0, n)
            known, asked = np.flatnonzero(settled), np.flatnonzero(~settled)
            _, which, times = np.unique(_met(np.repeat(common.one_chunk(table, "key").to_numpy(), n), h)[asked], return_inverse=True, return_counts=True)
            hit = asked[times[which] > 1]
            first, length = _runs(owner[hit], at[hit]) if len(hit) else (hit, hit)
            row_key, start, length = np.r_[owner[known], owner[hit][first]], np.r_[at[known], at[hit][first]], np.r_[h[known].astype(np.int64), length]
            if not len(start):
                continue
            spans = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32))], names=["start", "n"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1, dtype=np.int32)), spans)
            yield pa.RecordBatch.from_arrays([pa.array(row_key), lists], names=["row_key", "spans"])

    # a row that repeats in full counts as often as it stands there
    dealt = open_.mapInArrow(strings, "key bigint, salt int, owners binary, at binary, hashes binary").repartition("key", "salt").sortWithinPartitions("key", "salt")
    return dealt.mapInArrow(repeats, "row_key bigint, spans array<struct<start:int,n:int>>")
