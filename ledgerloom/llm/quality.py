"""Quality classifier (operator 8): a weak-label model, and a hashed linear scorer trained on its posteriors.

Labellers are simple rules, each of one aspect of a text: signs, capitals, repeats or tone; each votes good, bad
or neither, and those of an aspect overlap.  Tone has a lexicon of words that rows labelled toxic have far more often
than others, learned from a bounded sample of them (``LABELLED`` of either kind); without labels it has no vote.  Votes of all documents are counted by pattern, a table of a size that depends on the number of labellers alone.
Per aspect, expectation-maximisation on these counts estimates how each labeller votes on good and on bad texts, and the
posterior of each pattern; a text is good if no aspect says it is bad.  A linear scorer over hashed words and binned
measurements is then fitted by logistic regression on a bounded sample of documents with their posterior labels
(``SAMPLE`` of either class), and scores every document.

Defined results: a null text is an empty text, in which no labeller finds a fault; equal texts score alike, so ties
and repeated rows are treated alike; with no documents, or with posteriors of one class only, the posteriors decide alone;
an empty table gives no rows; other columns are kept, and the added ones replace columns of their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import common

BUCKETS = 1 << 16
#: Texts of each class that the scorer learns from, at most about.
SAMPLE = 3000
#: Labelled rows of each kind that the lexicon is learned from, at most about.
LABELLED = 4000
#: Score from which a document is rejected.
REJECT = 0.5

_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in "#$%&*|~^<>{}[]\\_!"]] = True
_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,;:!?*#$%&|\"')("]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def _hashes(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    at = np.r_[0, np.cumsum([len(x) for x in data])]
    return np.unique(common.span_hash(common.prefix_hash(np.frombuffer(b"".join(data), np.uint8)), at[:-1], at[1:]))


class Measured:
    """Measurements of some documents, and the hash of every word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lexicon: np.ndarray = np.zeros(0, np.uint64)):
        def per_doc(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            return np.diff(np.r_[0, np.cumsum(mask, dtype=np.int64)][bounds])

        low = common.folded(data)
        s, e, self.first = common.words(low, at)
        self.words = np.diff(self.first)
        end = e.copy()
        for _ in range(4):
            end -= (end - 1 > s) & _TAIL[low[end - 1]] if len(end) else 0
        self.hash = common.span_hash(common.prefix_hash(low), s, end) if len(s) else np.zeros(0, np.uint64)
        n = np.maximum(self.words, 1)
        letters = per_doc(_UPPER[data] | _LOWER[data], at)
        # one repeat or two signs are no fault of a short text
        self.signs = np.maximum(per_doc(_SIGNS[data], at) - 2, 0) / np.maximum(np.diff(at), 1)
        self.capitals = per_doc(_UPPER[data], at) / np.maximum(letters, 1)
        again = np.zeros(len(s), bool)
        if len(s) > 1:
            again[1:] = self.hash[1:] == self.hash[:-1]
            again[self.first[:-1][self.words > 0]] = False
        self.repeats = np.maximum(per_doc(again, self.first) - 1, 0) / n
        self.cells = per_doc((e - s == 1) & _SIGNS[low[s]], self.first) / n if len(s) else np.zeros(len(at) - 1)
        self.tails = per_doc(_SIGNS[low[e - 1]], self.first) / n if len(s) else np.zeros(len(at) - 1)
        self.learned = per_doc(np.isin(self.hash, lexicon), self.first)
        self.learned_rate = self.learned / n


#: Labellers: name, aspect, measurement, good up to, bad from (or the other way round where good is above bad).
LABELLERS = [
    ("signs", "signs", "signs", 0.01, 0.03),
    ("tails", "signs", "tails", 0.03, 0.15),
    ("cells", "signs", "cells", 0.02, 0.1),
    ("capitals", "capitals", "capitals", 0.15, 0.3),
    ("many capitals", "capitals", "capitals", 0.3, 0.6),
    ("repeats", "repeats", "repeats", 0.02, 0.06),
    ("many repeats", "repeats", "repeats", 0.06, 0.25),
    ("learned", "tone", "learned", 1, 3),
    ("learned rate", "tone", "learned_rate", 0.002, 0.006),
]
ASPECTS = sorted({x[1] for x in LABELLERS})


def votes(m: Measured) -> np.ndarray:
    """Documents x labellers: 0 neither, 1 good, 2 bad."""
    out = []
    for _, _, name, good, bad in LABELLERS:
        x = getattr(m, name)
        out.append(np.where(x >= bad, 2, np.where(x <= good, 1, 0)) if bad > good else np.where(x <= bad, 2, np.where(x >= good, 1, 0)))
    return np.array(out).T.reshape(-1, len(LABELLERS))


_PLACES = 3 ** np.arange(len(LABELLERS))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of bad for vote patterns (patterns x labellers) and the labellers' vote rates (class x labeller x vote).

    Starts from the share of bad votes; every labeller is taken to be right more often than not, by a prior worth a
    hundredth of the documents.
    """
    said = np.maximum((patterns > 0).sum(1), 1)
    p = np.clip(((patterns == 2).sum(1) / said) ** 0.5, 0.02, 0.98)
    total = max(counts.sum(), 1)
    weight = max(1.0, 0.01 * total)
    prior = np.array([[0.2, 0.7, 0.1], [0.2, 0.1, 0.7]])
    for _ in range(rounds):
        rates = np.empty((2, patterns.shape[1], 3))
        for k, share in enumerate((1 - p, p)):
            for v in range(3):
                rates[k, :, v] = ((counts * share)[:, None] * (patterns == v)).sum(0) + weight * prior[k, v]
        rates /= rates.sum(2, keepdims=True)
        base = np.clip((counts * p).sum() / total, 0.005, 0.5)
        j = np.arange(patterns.shape[1])
        like = [np.log(rates[k][j, patterns]).sum(1) for k in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(like[0] + np.log(1 - base) - like[1] - np.log(base), -50, 50)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, rates


def features(m: Measured, k: int) -> np.ndarray:
    """Hashed features of document ``k``: its distinct words, and last its binned measurements, one for each labeller."""
    own = (m.hash[m.first[k] : m.first[k + 1]] >> np.uint64(48)).astype(np.int64)
    return np.r_[np.unique(own), _bins(m)[k]]


def _bins(m: Measured) -> np.ndarray:
    """Documents x labellers: buckets of the measurements' bins."""
    if not hasattr(m, "bins"):
        cols = []
        for j, (_, _, name, good, bad) in enumerate(LABELLERS):
            x = getattr(m, name)
            edges = np.unique([good, bad, (good + bad) / 2, 2 * max(good, bad), 4 * max(good, bad)])
            cols.append(np.searchsorted(edges, x, "right") * 31 + j * 997 + 7)
        m.bins = np.array(cols).T.reshape(-1, len(LABELLERS)) * 40503 % BUCKETS
    return m.bins


def patterns(docs: DataFrame, lexicon: np.ndarray) -> DataFrame:
    """``h, pattern`` of every row: a hash of its text, and its votes as one number."""

    def vote(batches):
        for batch in batches:
            data, at = common.utf8(common.column_of(batch, "text"))
            out = [votes(Measured(data[at[a] : at[b]], at[a : b + 1] - at[a], lexicon)) @ _PLACES for a, b in common.steps(at)]
            yield pa.RecordBatch.from_arrays([common.column_of(batch, "h"), pa.array(np.concatenate(out) if out else np.zeros(0), pa.int32())], names=["h", "pattern"])

    text = common.text_or_empty()
    return docs.select(F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(vote, "h bigint, pattern int")


def _features(lexicon):
    @F.arrow_udf(returnType=T.ArrayType(T.IntegerType()))
    def found(text: pa.Array) -> pa.Array:
        data, at = common.utf8(text)
        out = []
        for a, b in common.steps(at):
            m = Measured(data[at[a] : at[b]], at[a : b + 1] - at[a], lexicon)
            out += [features(m, k).tolist() for k in range(b - a)]
        return pa.array(out, pa.list_(pa.int32()))

    return found


@F.arrow_udf(returnType=T.ArrayType(T.LongType()))
def _distinct_words(text: pa.Array) -> pa.Array:
    data, at = common.utf8(text)
    out = []
    for a, b in common.steps(at):
        m = Measured(data[at[a] : at[b]], at[a : b + 1] - at[a])
        out += [np.unique(m.hash[m.first[k] : m.first[k + 1]]).view(np.int64) for k in range(b - a)]
    return pa.array(out, pa.list_(pa.int64()))


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = LABELLED, least_docs: int = 6, least_share: float = 0.02, least_ratio: float = 20.0, most_words: int = 5000) -> np.ndarray:
    """Hashes of the words that texts labelled toxic have ``least_ratio`` times as often as others.

    Near copies, which share their least word hash, count as one text; a word needs ``least_docs`` toxic texts and
    ``least_share`` of them, so that the words of one much copied text aren't taken for signs of tone.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).where("toxic in (0, 1)").collect()}
    if not n.get(1) or not n.get(0):
        return np.zeros(0, np.uint64)
    rate = F.when(F.col("toxic") == 1, min(1.0, sample / n[1])).when(F.col("toxic") == 0, min(1.0, sample / n[0]))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    taken = known.where(chance < rate)  # about 2 * sample rows
    texts = docs.select("doc_id", common.text_or_empty().alias("text")).join(F.broadcast(taken), "doc_id").withColumn("h", F.xxhash64("text"))
    # of the rows with one doc_id, one text
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("h", "text", "toxic")).alias("row")).select("row.*").dropDuplicates(["h"])
    words = texts.select("toxic", _distinct_words("text").alias("w"))
    words = words.withColumn("least", F.array_min(F.transform("w", lambda x: F.xxhash64(x)))).dropDuplicates(["toxic", "least"]).select("toxic", "w").cache()
    size = {r["toxic"]: r["n"] for r in words.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ratio = ((F.col("t") + 0.1) / (size.get(1, 0) + 1)) / ((F.col("o") + 0.5) / (size.get(0, 0) + 1))
    by_word = words.select("toxic", F.explode("w").alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    found = by_word.where((F.col("t") >= max(least_docs, least_share * size.get(1, 0))) & (ratio >= least_ratio)).orderBy(ratio.desc(), "w").limit(most_words).select("w").toArrow()["w"].to_numpy()
    words.unpersist()
    return np.sort(found.view(np.uint64))


class Model:
    """The learned lexicon, posteriors of vote patterns, and the scorer's weights."""

    def __init__(self, lexicon: np.ndarray, posterior: dict[int, float], weights: np.ndarray | None, bias: float = 0.0):
        self.lexicon, self.posterior, self.weights, self.bias = lexicon, posterior, weights, bias


def _posteriors(counts: dict[int, int]) -> dict[int, float]:
    codes = np.array(sorted(counts), np.int64)
    if not len(codes):
        return {}
    n = np.array([counts[c] for c in codes.tolist()], float)
    pattern = codes[:, None] // _PLACES % 3
    good = np.ones(len(codes))
    for aspect in ASPECTS:
        own = [j for j, x in enumerate(LABELLERS) if x[1] == aspect]
        kinds, which = np.unique(pattern[:, own], axis=0, return_inverse=True)
        p, _ = estimate(kinds, np.bincount(which.ravel(), n))
        good *= 1 - p[which.ravel()]
    return dict(zip(codes.tolist(), (1 - good).tolist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> Model:
    """Estimate the labellers on all documents and train the scorer on a sample."""
    lexicon = learn_lexicon(docs, labels) if labels is not None else np.zeros(0, np.uint64)
    coded = common.staged(patterns(docs, lexicon), "quality-patterns")
    counts = {r["pattern"]: r["n"] for r in coded.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # at most 3 ** labellers rows
    posterior = _posteriors(counts)
    bad = [c for c, p in posterior.items() if p >= 0.5]
    n_bad = sum(counts[c] for c in bad)
    n_good = sum(counts.values()) - n_bad
    if not n_bad or not n_good:
        return Model(lexicon, posterior, None)
    table = docs.sparkSession.createDataFrame(pa.table({"pattern": pa.array(list(posterior), pa.int32()), "p": pa.array(list(posterior.values()), pa.float64())}))
    rate = F.when(F.col("p") >= 0.5, F.lit(min(1.0, sample / n_bad))).otherwise(F.lit(min(1.0, sample / n_good)))
    chance = F.pmod(F.xxhash64("h", F.lit(8)), F.lit(1 << 20)) / float(1 << 20)
    # at most about 2 * sample rows: a text is drawn once, however many rows repeat it
    chosen = coded.join(F.broadcast(table), "pattern").where(chance < rate).groupBy("h").agg(F.max("p").alias("p"))
    texts = docs.select(common.text_or_empty().alias("text")).withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), "h").dropDuplicates(["h"])
    taken = texts.select("p", _features(lexicon)("text").alias("x")).toArrow()
    y = taken["p"].to_numpy()
    x = [np.array(v, np.int64) for v in taken["x"].to_pylist()]
    order = sorted(range(len(y)), key=lambda k: (len(x[k]), y[k], x[k].tobytes()))
    weights, bias = logistic([x[k] for k in order], y[order])
    return Model(lexicon, posterior, weights, bias)


def logistic(x: list[np.ndarray], y: np.ndarray, epochs: int = 8, rate: float = 0.2, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on features, by adaptive gradient steps in a fixed random order; all words together weigh as one."""
    rng = np.random.default_rng(8)
    weights, seen, bias, bias_seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2), 0.0, 1e-2
    for _ in range(epochs):
        for k in rng.permutation(len(y)):
            f = x[k]
            words = len(f) - len(LABELLERS)
            value = np.ones(len(f))
            value[:words] /= np.sqrt(max(words, 1))
            g = 1 / (1 + np.exp(-np.clip(weights[f] @ value + bias, -30, 30))) - y[k]
            step = g * value
            seen[f] += step * step
            weights[f] -= rate * (step / np.sqrt(seen[f]) + decay * weights[f])
            bias_seen += g * g
            bias -= rate * g / np.sqrt(bias_seen)
    return weights.astype(np.float32), float(bias)


def scores(model, texts: pa.Array) -> np.ndarray:
    """The score of each text: 0 good, 1 bad."""
    lexicon, posterior, weights, bias = model
    data, at = common.utf8(texts)
    out = [np.zeros(0)]
    for a, b in common.steps(at):
        m = Measured(data[at[a] : at[b]], at[a : b + 1] - at[a], lexicon)
        if weights is None:
            out.append(np.array([posterior.get(c, 0.0) for c in (votes(m) @ _PLACES).tolist()]))
            continue
        key = np.unique(np.repeat(np.arange(b - a), m.words) * BUCKETS + (m.hash >> np.uint64(48)).astype(np.int64))
        owner = key // BUCKETS
        total = np.bincount(owner, weights[key % BUCKETS], b - a) / np.sqrt(np.maximum(np.bincount(owner, minlength=b - a), 1))
        total += weights[_bins(m)].sum(1)
        out.append(1 / (1 + np.exp(-np.clip(total + bias, -30, 30))))
    return np.concatenate(out)


def _scored(docs: DataFrame, model: Model, rest: list[str], only_kept: bool) -> DataFrame:
    """The columns ``rest`` of all documents with score and verdict, or of the kept ones alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.posterior, model.weights, model.bias))  # of fixed size
    added = [] if only_kept else [T.StructField("score", T.DoubleType()), T.StructField("keep", T.BooleanType())]

    def work(batches):
        for batch in batches:
            score = scores(shared.value, common.column_of(batch, "text"))
            columns = [common.column_of(batch, c) for c in rest]
            if only_kept:
                yield pa.RecordBatch.from_arrays(columns, names=rest).filter(pa.array(score < REJECT))
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array(score < REJECT)], names=[*rest, "score", "keep"])

    needed = docs.select(*dict.fromkeys([*rest, "text"]))
    return needed.mapInArrow(work, T.StructType([*(docs.schema[c] for c in rest), *added]))


def classify(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``docs`` without their text, with ``score`` (0 good to 1 bad) and ``keep``."""
    return _scored(docs, fit(docs, labels), [c for c in docs.columns if c not in ("text", "score", "keep")], only_kept=False)


def accepted(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The documents that the classifier keeps, with the columns they had."""
    return _scored(docs, fit(docs, labels), docs.columns, only_kept=True)
