"""N-gram Jaccard join (operator 3): MinHash banding, then verification on full n-gram sets.

N-grams are runs of ``n`` words (split at white space, lower case); a shorter text is one n-gram.  Texts with the same
set of n-grams are one *set*, for which one row is verified.  ``BANDS`` bands of ``ROWS`` MinHash values follow from the
threshold and the target recall (``choose_bands``); sets that agree on a band's hash meet in its bucket.

Buckets compare one-byte MinHash sketches of all their pairs, a large bucket in blocks, and pass on a spanning forest of
pairs whose estimate isn't far below the threshold.  The components of these forests gather what has to be verified in
one place: a component is dealt by hash into blocks of about ``BLOCK`` sets, every two blocks meet in a task with the
sets' full n-grams, and all their pairs are verified exactly by a product of sparse indicator matrices.  A task returns,
per set, the number of linked documents and a spanning forest of the links, never the pairs.  Components of verified
links are the classes.

Result, one row for each row of the input: ``class_id`` (least doc_id of the class) and ``n_links`` (the number of other
rows whose n-gram set has a Jaccard similarity of at least the threshold).

Defined results: null and empty texts, or texts of white space alone, have the empty n-gram set and are alike; repeated
rows are linked like other copies; a row without doc_id is linked like any other and names no class, so that the class_id
is null where all rows of a class have none; an empty table gives no rows; ``join`` ignores other columns, ``one_of_each``
keeps them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common
from ledgerloom.llm.components import components

N = 5
THRESHOLD = 0.8
RECALL = 0.997
#: Sets of a component that are verified against each other in one task.
BLOCK = 512
#: Sketches of a bucket that are compared in one task.
BUCKET_BLOCK = 768
#: Estimates down to so much under the threshold are verified: more than five standard errors of the sketch.
SLACK = 0.2


def choose_bands(threshold: float, recall: float, hashes: int = 120) -> tuple[int, int]:
    """Bands and rows: the most rows a band (fewest false meetings) that still find a pair at the threshold with this chance."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


BANDS, ROWS = choose_bands(THRESHOLD, RECALL)
_rng = np.random.default_rng(77)
_A = (_rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_EMPTY = np.uint64(0x5EED)


def ngrams(data: np.ndarray, at: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each document, end to end, and where each document's begin."""
    data = common.folded(data)
    s, e, first = common.words(data, at)
    docs = len(at) - 1
    if not len(s):
        return np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64)
    h = common.span_hash(common.prefix_hash(data), s, e)
    count = np.diff(first)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    word = np.repeat(first[1:], count) - np.arange(len(h))  # words left in the document, this one too
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + np.where(word > k, padded[k : k + len(h)], _EMPTY)
    keep = (word >= n) | (np.arange(len(h)) == np.repeat(first[:-1], count)) & (np.repeat(count, count) < n)
    grams, owner = common.mixed(total[keep]), np.repeat(np.arange(docs), count)[keep]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(docs + 1))


def minhashes(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values, documents x (BANDS * ROWS); documents without n-grams get a row of their own kind."""
    docs = len(at) - 1
    out = np.full((docs, BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return out
    for a in range(0, len(some), 64):
        rows = some[a : a + 64]
        lo, hi = at[rows[0]], at[rows[-1] + 1]
        part = grams[lo:hi]
        starts = at[rows] - lo
        for k in range(BANDS * ROWS):
            out[rows, k] = np.minimum.reduceat(((part * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


_KEYS = ["doc_id", "key_a", "key_b"]
_SIGNED = "doc_id bigint, key_a bigint, key_b bigint, sig_a bigint, sig_b bigint, bands array<bigint>, sketch binary"


def signatures(rows: DataFrame) -> DataFrame:
    """Of each ``doc_id, key_a, key_b, text``: a 128-bit signature of its n-gram set, its band hashes and its one-byte sketch."""

    def sign(batches):
        for batch in batches:
            keys = [common.column_of(batch, c) for c in _KEYS]
            data, at = common.utf8(common.column_of(batch, "text"))
            for first, last in common.steps(at):
                grams, begin = ngrams(data[at[first] : at[last]], at[first : last + 1] - at[first])
                m = minhashes(grams, begin)
                docs = last - first
                prefix = np.r_[np.uint64(0), np.cumsum(common.mixed(grams))]
                other = np.r_[np.uint64(0), np.cumsum(common.mixed(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]
                sig_a = common.mixed(prefix[begin[1:]] - prefix[begin[:-1]] + np.diff(begin).astype(np.uint64))
                sig_b = common.mixed(other[begin[1:]] - other[begin[:-1]])
                wide = m.astype(np.uint64).reshape(docs, BANDS, ROWS)
                band = np.zeros((docs, BANDS), np.uint64)
                for r in range(ROWS):
                    band = common.mixed(band * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, r] + np.uint64(1))
                band += np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(docs + 1, dtype=np.int32) * BANDS), pa.array(band.ravel().view(np.int64)))
                sketch = (m & 0xFF).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, docs) for c in keys), pa.array(sig_a.view(np.int64)), pa.array(sig_b.view(np.int64)), lists, pa.array([r.tobytes() for r in sketch], pa.binary())],
                    names=[*_KEYS, "sig_a", "sig_b", "bands", "sketch"],
                )

    return rows.mapInArrow(sign, _SIGNED)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links i-j between n things: (thing, root)."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while (root[root] != root).any():
            root = root[root]
    linked = np.flatnonzero(root != np.arange(n))
    return list(zip(linked.tolist(), root[linked].tolist(), strict=True))


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of all rows of two matrices of sketches."""
    same = np.zeros((len(x), len(y)), np.uint16)
    for k in range(x.shape[1]):
        same += x[:, k, None] == y[None, :, k]
    return (same / x.shape[1] - 1 / 256) / (1 - 1 / 256)


def candidate_forest(reps: DataFrame) -> DataFrame:
    """``a, b``: for every pair of sets that meets in a bucket and may be alike, a path of such pairs."""
    met = reps.select("rep", F.explode("bands").alias("bucket"))
    sizes = met.groupBy("bucket").agg(F.count("*").alias("m"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("m > 1")
    sizes = common.staged(sizes, "ngram-buckets")
    sketches = reps.select("rep", "sketch")

    pairs = sizes.where("m = 2").select("lo", "hi").distinct()
    pairs = pairs.join(sketches.select(F.col("rep").alias("lo"), F.col("sketch").alias("x")), "lo").join(sketches.select(F.col("rep").alias("hi"), F.col("sketch").alias("y")), "hi")

    def check(batches):
        for batch in batches:
            x, y = (np.frombuffer(common.utf8(common.column_of(batch, c))[0].tobytes(), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
            near = pa.array(((x == y).mean(1) - 1 / 256) / (1 - 1 / 256) >= THRESHOLD - SLACK)
            yield pa.RecordBatch.from_arrays([common.column_of(batch, "lo").filter(near), common.column_of(batch, "hi").filter(near)], names=["a", "b"])

    found = pairs.mapInArrow(check, "a bigint, b bigint")

    blocks = F.ceil(F.col("m") / BUCKET_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int")
    large = met.join(sizes.where("m > 2").select("bucket", blocks.alias("blocks")), "bucket").withColumn("own", own).join(sketches, "rep")
    dealt = large.select("bucket", "rep", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "rep", "sketch", "own")

    def compare(batches):
        for table in common.grouped(batches, ["bucket", "p", "q"]):
            rep, own = common.one_chunk(table, "rep").to_numpy(), common.one_chunk(table, "own").to_numpy()
            sketch = np.frombuffer(common.utf8(common.one_chunk(table, "sketch"))[0].tobytes(), np.uint8).reshape(len(rep), -1)
            p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
            left = np.flatnonzero(own == p)
            right = left if p == q else np.flatnonzero(own == q)
            i, j = np.nonzero(alike(sketch[left], sketch[right]) >= THRESHOLD - SLACK)
            links = _forest(len(rep), left[i], right[j])
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(rep[list(a)]), pa.array(rep[list(b)])], names=["a", "b"])

    return found.unionByName(dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q").mapInArrow(compare, "a bigint, b bigint"))


def verified(reps_text: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``rep, root, links``: exact links of the sets of each component (``label, rep, copies, blocks, text``), by block pair."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    dealt = reps_text.withColumn("own", own).select("label", "rep", "copies", "text", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("label", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "rep", "copies", "own", "text")

    def verify(batches):
        for table in common.grouped(batches, ["label", "p", "q"]):
            rep, own, copies = (common.one_chunk(table, c).to_numpy() for c in ("rep", "own", "copies"))
            data, at = common.utf8(common.one_chunk(table, "text"))
            grams, begin = ngrams(data, at)
            size = np.diff(begin)
            _, column = np.unique(grams, return_inverse=True)
            p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
            left = np.flatnonzero(own == p)
            right = left if p == q else np.flatnonzero(own == q)
            if not len(left) or not len(right):
                continue
            shared = common_counts(column, begin, left, right)
            both = size[left][:, None] + size[right][None, :]
            near = shared * (1 + threshold) >= threshold * both - 1e-9
            if p == q:
                np.fill_diagonal(near, False)
            i, j = np.nonzero(near)
            links = np.zeros(len(rep), np.int64)
            np.add.at(links, left[i], copies[right[j]])
            if p != q:
                np.add.at(links, right[j], copies[left[i]])
            root = np.arange(len(rep))
            for a, b in _forest(len(rep), left[i], right[j]):
                root[a] = b
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[root[some]]), pa.array(links[some])], names=["rep", "root", "links"])

    return dealt.repartition("label", "p", "q").sortWithinPartitions("label", "p", "q").mapInArrow(verify, "rep bigint, root bigint, links bigint")


def common_counts(column: np.ndarray, begin: np.ndarray, left: np.ndarray, right: np.ndarray, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right ones, from numbered elements."""
    n_columns = int(column.max()) + 1 if len(column) else 0
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    place = np.full(len(begin) - 1, -1)
    place[left] = np.arange(len(left))
    other = np.full(len(begin) - 1, -1)
    other[right] = np.arange(len(right))
    times = np.bincount(column, minlength=n_columns)
    number = np.cumsum(times > 1) - 1  # elements of one set alone can't be shared
    used = times[column] > 1
    column, owner = number[column[used]], owner[used]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    n_columns = int(number[-1]) + 1 if len(number) else 0
    for a in range(0, n_columns, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        c, o = column[lo:hi] - a, owner[lo:hi]
        m = place[o] >= 0
        x[place[o[m]], c[m]] = 1
        m = other[o] >= 0
        y[other[o[m]], c[m]] = 1
        out += x @ y.T
    return np.rint(out).astype(np.int64)


def row_keys() -> tuple[Column, Column]:
    """A 128-bit key of a row's doc_id and text: rows share it only if they repeat both."""
    parts = (F.col("doc_id").isNull(), F.col("doc_id").cast("long"), common.text_or_empty())
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (``doc_id, key_a, key_b, sig_a, sig_b``), and each set's ``sig_a, sig_b, class, class_id, n_links``."""
    key_a, key_b = row_keys()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text"), key_a.alias("key_a"), key_b.alias("key_b"))
    signed = common.staged(signatures(keyed.select(*_KEYS, "text")), "ngram-signatures")
    sets = signed.groupBy("sig_a", "sig_b").agg(
        F.min("doc_id").alias("least_doc"), F.count("*").alias("copies"), F.min(F.struct("key_a", "key_b")).alias("key"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    # numbered once and written, so that the number of a set is its own and stays
    sets = common.staged(sets.withColumn("set", F.monotonically_increasing_id()), "ngram-sets")
    of_set = sets.drop("bands", "sketch")

    candidates = components(candidate_forest(sets.select(F.col("set").alias("rep"), "bands", "sketch")))
    candidates = common.staged(candidates, "ngram-candidates")
    blocks = candidates.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = candidates.join(blocks, "label").select(F.col("node").alias("set"), "label", "blocks").join(of_set, "set")
    with_text = members.select(F.col("set").alias("rep"), "label", "blocks", "copies", "key.key_a", "key.key_b")
    # the text of a set: that of the row with its least key, once if that row is repeated
    texts = keyed.select("key_a", "key_b", "text").join(with_text, ["key_a", "key_b"]).dropDuplicates(["key_a", "key_b"])
    links = common.staged(verified(texts.select("label", "rep", "copies", "blocks", "text")), "ngram-links")

    classes = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("rep").agg(F.sum("links").alias("links"))
    named = of_set.join(classes.select(F.col("node").alias("set"), "label"), "set", "left").join(linked.withColumnRenamed("rep", "set"), "set", "left")
    least = named.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("least_doc").alias("class_id"))
    named = named.join(least, "label", "left").select("sig_a", "sig_b", F.coalesce("label", "set").alias("class"), F.coalesce("class_id", "least_doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select(*_KEYS, "sig_a", "sig_b"), named


def join(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row."""
    rows, named = classified(docs)
    return rows.select("doc_id", "sig_a", "sig_b").join(named, ["sig_a", "sig_b"]).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns: the one with the least doc_id, one without only if no other has any.

    Rows that share a doc_id and not their text stand each for themselves; of rows that repeat both, any one.
    """
    rows, named = classified(docs)
    rows = rows.join(named.select("sig_a", "sig_b", "class"), ["sig_a", "sig_b"])
    least = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.struct("key_a", "key_b").alias("key"))).alias("row"))
    new = "_" * (1 + max(len(c) for c in docs.columns))  # names that no column has
    key = [f"{new}a", f"{new}b"]
    kept = common.staged(least.select(F.col("row.key.key_a").alias(key[0]), F.col("row.key.key_b").alias(key[1])), "ngram-kept")
    # the join's partitions serve the removal of repeated rows too, so that texts are shuffled once
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(row_keys(), key, strict=True)))
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)
