"""Language identification (operator 1): multinomial naive Bayes over hashed character n-grams.

Training counts 1-, 2- and 3-grams of code points (lower case, white space as one blank, a blank before the text and
blanks after it) into ``BUCKETS`` hash buckets per language, in Spark tasks, and sums the counts by (language, bucket).  The matrix
of log probabilities, languages x buckets, is broadcast; its size is fixed by the number of languages and buckets.
Scoring takes whole batches: all n-grams of a batch of texts are hashed at once, and each language's log probabilities
are gathered and summed by document.

Defined results: a null text or one without a letter is ``und`` with score 0; so is everything if there is nothing to
learn from; ties go to the first language in alphabetical order; repeated rows are scored alike; an empty table gives no
rows; further columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import common

BUCKETS = 1 << 16
#: About so many documents of each language are learned from, chosen by a hash of doc_id and text; fewer if there are fewer.
DOCS_PER_LANGUAGE = 4000
UNKNOWN = "und"

_LOWER = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x10000))], np.uint32)
_LOWER[[k for k in range(0x10000) if chr(k).isspace()]] = 32
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def gram_buckets(texts: pa.Array):
    """Hash buckets of all n-grams of a column of texts, by n: (buckets of that n, where each document's begin)."""
    data, at = common.utf8(texts)
    for first, last in common.steps(at):
        part = data[at[first] : at[last]]
        heads = (part & 0xC0) != 0x80
        before = np.r_[0, np.cumsum(heads, dtype=np.int64)]
        begin = before[at[first : last + 1] - at[first]]
        codes = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        low = codes < 0x10000
        codes = np.where(low, _LOWER[np.where(low, codes, 0)], codes)
        n = last - first
        padded = np.full(len(codes) + 2 * n, 32, np.uint32)
        owner = np.repeat(np.arange(n), np.diff(begin))
        padded[np.arange(len(codes)) + 2 * owner + 1] = codes
        start = begin + 2 * np.arange(n + 1)
        h = padded * _MULTIPLIERS[0]
        out = [h]
        for k in (1, 2):
            ahead = np.full(len(padded), 32, np.uint32)
            ahead[:-k] = padded[k:]
            for j in range(k):  # what follows a document is blank, whatever stands next in the batch
                ahead[start[1:] - 1 - j] = 32
            h = h + ahead * _MULTIPLIERS[k]
            out.append(h)
        kinds = []
        for k, h in enumerate(out):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
            kinds.append((h >> np.uint32(16)).astype(np.int64))
        yield first, last, kinds, start


def train(labelled: DataFrame, buckets: int = BUCKETS, docs_per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (languages x buckets) from rows with ``doc_id, text, lang``."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row for each language
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((0, buckets), np.float32)
    rate = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / sizes[k]))])
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(chance < rate[F.col("lang")]).select("text", "lang")
    number = {k: i for i, k in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), buckets), np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in common.column_of(batch, "lang").to_pylist()], np.int64)
            for first, last, kinds, start in gram_buckets(common.column_of(batch, "text")):
                of = np.repeat(lang[first:last], np.diff(start)) * buckets
                for b in kinds:
                    total += np.bincount(of + b, minlength=total.size).reshape(total.shape)
        k, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(b, pa.int32()), pa.array(total[k, b])], names=["k", "b", "n"])

    counts = sample.mapInArrow(count, "k int, b int, n bigint").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()  # languages x buckets at most
    matrix = np.zeros((len(languages), buckets))
    matrix[counts["k"].to_numpy(), counts["b"].to_numpy()] = counts["n"].to_numpy()
    matrix += 0.5
    return languages, np.log(matrix / matrix.sum(1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred`` and ``score`` (the posterior of that language)."""
    languages, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast((languages, np.ascontiguousarray(matrix)))
    rest = [f for f in docs.schema.fields if f.name not in (text, "lang_pred", "score")]
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))

    def score(batches):
        languages, matrix = shared.value
        for batch in batches:
            known = np.asarray(common.column_of(batch, "has_letter").to_numpy(zero_copy_only=False), bool)
            best, sure = np.full(batch.num_rows, len(languages)), np.zeros(batch.num_rows)
            if languages:
                for first, last, kinds, start in gram_buckets(common.column_of(batch, text)):
                    sums = np.zeros((len(languages), last - first))
                    for k in range(len(languages)):
                        row = matrix[k]
                        at_each = row[kinds[0]]
                        for b in kinds[1:]:
                            at_each += row[b]
                        sums[k] = np.add.reduceat(at_each, start[:-1], dtype=np.float64)
                    top = sums.max(0)
                    best[first:last] = sums.argmax(0)
                    sure[first:last] = 1 / np.exp(sums - top).sum(0)
            best = np.where(known, best, len(languages))
            sure = np.where(best < len(languages), sure, 0.0)
            names = pa.array([*languages, UNKNOWN]).take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*(common.column_of(batch, f.name) for f in rest), names, pa.array(sure)], names=[*(f.name for f in rest), "lang_pred", "score"])

    schema = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*(f.name for f in rest), text_column(text), has_letter.alias("has_letter")).mapInArrow(score, schema)


def text_column(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def held_out() -> Column:
    """Documents that are never learned from: crc32 of the doc_id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out and predict all."""
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
