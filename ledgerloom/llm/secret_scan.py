"""Secret scans (operator 6): base patterns, and a character convolutional network over every candidate.

Candidates are the matches of three base patterns (assignments, of which the value is read, access keys, long hex
strings), and every run of ``LEAST`` or more token characters that has a letter, or what base matches leave of it on
either side.  The network reads each candidate with its surrounding context as characters, a longer one in windows of
``INSIDE`` characters, ``STRIDE`` apart, of which the highest score counts: an embedding, one convolution, the maximum over the candidate and over what stands before it, and
a linear layer, all in numpy.  It is trained on labelled findings: made by rule from fixed seeds, secrets of many shapes
in secret contexts and look-alikes (numbers, addresses, links, long words, digests of files) in plain ones.  A held-out
part calibrates its scores (a line through the log-odds) and sets the threshold: the highest that keeps
``RECALL`` of the held-out secrets.  Base matches are findings whatever their score; other candidates at or over the
threshold are added as spans of kind ``net``.

Positions are code points, ends are exclusive.  Per kind, matches are leftmost and don't overlap; candidates
don't overlap base matches.  Spans are ordered by start, then assign, access, hex, net.

Defined results: null and empty texts have no spans; repeated rows are scanned alike; an empty table gives no rows;
extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import common

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "net")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Token characters in a candidate beyond the base patterns, at least.
LEAST = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
RECALL = 0.98
#: Labelled findings of either kind.
FINDINGS = 1500
BEFORE, INSIDE, AFTER = 32, 48, 8
#: Any secret of up to INSIDE - STRIDE + 1 characters is in one window as a whole.
STRIDE = 8
WIDTH = BEFORE + INSIDE + AFTER
#: Windows that the network reads at once; a long text's aren't held together.
AT_ONCE = 512

_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """Start, kind and end of the base matches, and where the value begins."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def covered(base: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """The base matches as stretches in order, of which none meets another."""
    out: list[list[int]] = []
    for start, _, end, _ in base:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def other_candidates(text: str, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Runs of token characters with a letter, less the base matches in them; both are walked along the text once."""
    out, stretches, first = [], covered(base), 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while first < len(stretches) and stretches[first][1] <= start:
            first += 1
        k = first
        while start < end:
            a, b = stretches[k] if k < len(stretches) and stretches[k][0] <= end else (end, end)
            if a > start and any(c.isalpha() for c in text[start:a]):
                out.append((start, a))
            start = max(start, b)
            k += 1
    return out


def suspects(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Documents that may hold a candidate, from their bytes alone: a keyword, or a run of token characters with a letter."""
    hit = np.zeros(len(at) - 1, bool)
    low = data.tobytes().lower()
    for word in _KEYWORDS:
        k = low.find(word)
        while k >= 0:
            doc = int(np.searchsorted(at, k, "right")) - 1
            hit[doc] = True
            k = low.find(word, int(at[doc + 1]))
    token = np.r_[False, _TOKEN[data], False]
    edges = np.flatnonzero(token[1:] != token[:-1])
    start, end = edges[::2], edges[1::2]
    long = np.flatnonzero(end - start >= LEAST)
    if len(long):
        letters = np.r_[0, np.cumsum(_LETTER[data])]
        s, e = start[long], end[long]
        letters_too = letters[e] > letters[s]
        letters_too |= e - s >= 32  # hex of digits alone
        s, e = s[letters_too], e[letters_too]
        first, last = np.searchsorted(at, s, "right") - 1, np.searchsorted(at, e - 1, "right") - 1
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            hit[a : b + 1] = True
    every = data.tobytes()
    k = every.find(b"AKIA")
    while k >= 0:  # each start, as one that reaches over a document's end may hide the next document's
        hit[int(np.searchsorted(at, k, "right")) - 1] = True
        k = every.find(b"AKIA", k + 1)
    return hit


# ---- the network ----------------------------------------------------------------------------------------------------
_ALPHABET = " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789\"'`:=.,;/\\_+-()[]{}<>@#$%&*!?|~^\n"
_NUMBER = {c: k + 1 for k, c in enumerate(_ALPHABET)}
_LETTERS, _EMBED, _FILTERS, _REACH = len(_ALPHABET) + 2, 8, 24, 5


def window(text: str, start: int, end: int) -> np.ndarray:
    """Characters before, in and after a candidate, as numbers."""
    left = text[max(0, start - BEFORE) : start].rjust(BEFORE)
    inside = text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0")
    right = text[end : end + AFTER].ljust(AFTER)
    return np.array([0 if c == "\0" else _NUMBER.get(c, _LETTERS - 1) for c in left + inside + right], np.int64)


def windows(text: str, start: int, end: int) -> Iterator[np.ndarray]:
    """Windows over the whole length of a candidate."""
    last = max(start, end - INSIDE)
    return (window(text, k, min(end, k + INSIDE)) for k in itertools.chain(range(start, last, STRIDE), [last]))


class Network:
    """Embedding, convolution, two maxima and a linear layer; trained by adaptive moments."""

    def __init__(self, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.3, (_LETTERS, _EMBED)),
            "conv": rng.normal(0, 0.2, (_REACH * _EMBED, _FILTERS)),
            "conv0": np.zeros(_FILTERS),
            "out": rng.normal(0, 0.2, 2 * _FILTERS),
            "out0": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray):
        e = self.p["embed"][x] * (x > 0)[:, :, None]
        cols = np.lib.stride_tricks.sliding_window_view(e, _REACH, 1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - _REACH + 1, -1)
        h = cols @ self.p["conv"] + self.p["conv0"]
        parts = (slice(0, BEFORE - 2), slice(BEFORE - 2, WIDTH - _REACH + 1))
        top = [h[:, s].argmax(1) + s.start for s in parts]
        rows, filters = np.arange(len(x))[:, None], np.arange(_FILTERS)
        best = np.hstack([h[rows, t, filters] for t in top])
        act = np.maximum(best, 0)
        return act @ self.p["out"] + self.p["out0"][0], (e, cols, top, best, act)

    def gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (_, cols, top, best, act) = self.forward(x)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(x)
        d_best = np.outer(g, self.p["out"]) * (best > 0)
        d_conv, d_embed = np.zeros_like(self.p["conv"]), np.zeros_like(self.p["embed"])
        for k, t in enumerate(top):
            d = d_best[:, k * _FILTERS : (k + 1) * _FILTERS]
            picked = cols[np.arange(len(x))[:, None], t]  # examples x filters x inputs
            d_conv += np.einsum("bf,bfi->if", d, picked)
            d_in = (d[:, :, None] * self.p["conv"].T[None]).reshape(len(x), _FILTERS, _REACH, _EMBED)
            chars = x[np.arange(len(x))[:, None, None], t[:, :, None] + np.arange(_REACH)]
            np.add.at(d_embed, chars.ravel(), d_in.reshape(-1, _EMBED))
        d_embed[0] = 0
        return {"embed": d_embed, "conv": d_conv, "conv0": (d_best[:, :_FILTERS] + d_best[:, _FILTERS:]).sum(0), "out": act.T @ g, "out0": np.array([g.sum()])}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, size: int = 64, rate: float = 0.01) -> Network:
        rng = np.random.default_rng(66)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), size):
                rows = order[a : a + size]
                t += 1
                for k, g in self.gradient(x[rows], y[rows]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> Network:
        """A line through the log-odds by Newton steps, then the highest threshold that keeps this recall."""
        z = self.forward(x)[0]
        w = np.array([1.0, 0.0])
        design = np.c_[z, np.ones(len(z))]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
            w = w - np.clip(np.linalg.solve(h, design.T @ (p - y) + 1e-3 * (w - [1, 0])), -1, 1)
        self.scale, self.shift = float(w[0]), float(w[1])
        kept = np.sort(self.score(x)[y == 1])
        self.threshold = float(kept[int((1 - recall) * len(kept))])
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = np.concatenate([self.forward(x[a : a + 512])[0] for a in range(0, len(x), 512)])
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def labelled_findings(n: int = FINDINGS, seed: int = 2024) -> list[tuple[str, int, int, int]]:
    """Text, start, end and label (1 secret) of ``n`` findings of either kind, made by rule."""
    r = random.Random(seed)
    lower, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    mixed = lower + lower.upper() + digits

    def pick(chars: str, a: int, b: int) -> str:
        return "".join(r.choice(chars) for _ in range(r.randint(a, b)))

    def word() -> str:
        return "".join(r.choice("bcdfghlmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 5)))

    def prose(a: int, b: int) -> str:
        return " ".join(word() for _ in range(r.randint(a, b)))

    def secret() -> str:
        return r.choice([
            lambda: pick(hexes, 32, 64), lambda: pick(mixed, 20, 44), lambda: "AKIA" + pick(lower.upper() + digits, 16, 16),
            lambda: base64.b64encode(r.randbytes(r.randint(18, 40))).decode(), lambda: base64.urlsafe_b64encode(r.randbytes(r.randint(18, 40))).decode(),
            lambda: r.choice(["gh", "sk", "pk", "xox"]) + r.choice("pobs") + r.choice("_-") + pick(mixed, 24, 40), lambda: "eyJ" + pick(mixed, 30, 44),
        ])()

    def name() -> str:
        return r.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "auth", "key", "credential", "access_key", "bearer", "pwd", "client_secret", "private_key", "signature"])

    def plain() -> str:
        return r.choice([
            lambda: word() + word() + word() + word() + pick(digits, 1, 4), lambda: pick(digits, 4, 6) + "-" + word() + "-" + word() + "-" + word(),
            lambda: "/".join(word() for _ in range(5)) + "/" + pick(digits, 1, 6), lambda: "item_" + pick(digits, 12, 18), lambda: "-".join([pick(digits, 4, 4), pick(digits, 2, 2), pick(digits, 2, 2), word() + word()]),
            lambda: word() + "_" + word() + "_" + word() + "_" + word() + "_v" + pick(digits, 1, 2), lambda: "ISBN-" + pick(digits, 13, 13) + "-" + word(), lambda: "=" * 20 + pick(digits, 1, 1) + "x",
            lambda: (word() * 4)[:20] + "2", lambda: "INV" + pick(digits, 14, 18), lambda: "-".join(word() + pick(digits, 0, 1) for _ in range(4)) + "1",
        ])()

    out = []
    for _ in range(n):
        quote = r.choice(["", '"', "'"])
        head = f"{prose(0, 6)} " + r.choice([f"{name()} = {quote}", f"{name()}: {quote}", f'"{name()}":{quote}', f"{name().upper()}={quote}", f"{name()} {quote}", "Authorization: Bearer "])
        value = secret()
        out.append((f"{head}{value}{quote} {prose(0, 3)}", len(head), len(head) + len(value), 1))
        head = r.choice([f"{prose(1, 8)} ", f"{prose(1, 4)}: ", f"{prose(0, 3)} https://{word()}.com/", f"{prose(1, 4)} (", f"{prose(0, 2)} id = ", f"{prose(1, 3)} sha1 file "])
        value = plain() if r.random() < 0.9 or "file" not in head else pick(hexes, 40, 40)
        out.append((f"{head}{value} {prose(0, 3)}", len(head), len(head) + len(value), 0))
    return out


def long_windows(n: int = FINDINGS // 3, seed: int = 4048) -> tuple[np.ndarray, np.ndarray]:
    """Windows inside long runs, and their labels: of ``n`` paths and slugs, and of as many secrets behind a path and behind an access key."""
    r = random.Random(seed)
    secrets = [t[a:b] for t, a, b, k in labelled_findings(n, seed) if k]
    x, y = [], []
    for value in secrets:
        sep = r.choice("//-_")
        words = ["".join(r.choice("bcdfghlmnprstvwy") + r.choice("aeiou") + r.choice(["", "", "n", "r", "s", "ck", "t"]) for _ in range(r.randint(1, 4))) + (str(r.randint(1, 99)) if r.random() < 0.2 else "") for _ in range(r.randint(6, 14))]
        run = sep.join(words)
        plain = list(windows(f"see {run} here", 4, 4 + len(run)))
        x += [w for k, w in enumerate(plain) if k in (0, len(plain) - 1) or r.random() < 0.3]
        y += [0.0] * (len(x) - len(y))
        head = f"see {run}{sep}"
        start = max(4, len(head) - r.randrange(STRIDE))
        x.append(window(f"{head}{value} here", start, min(start + INSIDE, len(head) + len(value))))
        head = "key AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
        rest = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(16, 40)))
        x.append(window(f"{head}{rest} here", len(head), len(head) + len(rest)))
        y += [1.0, 1.0]
    return np.array(x), np.array(y)


@functools.cache
def trained() -> Network:
    """The network, trained on windows inside long runs and two thirds of the labelled findings, calibrated on the rest."""
    found = labelled_findings()
    x, y = np.array([window(t, a, b) for t, a, b, _ in found]), np.array([float(k) for *_, k in found])
    held = np.arange(len(x)) // 2 % 3 == 2
    more, label = long_windows()
    return Network().fit(np.concatenate([x[~held], more]), np.concatenate([y[~held], label])).calibrate(x[held], y[held])


def find_spans(text: str, network: Network) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, float]]]:
    """Base spans, and all spans with their scores, of a text."""
    base = base_spans(text)
    more = other_candidates(text, base)
    if not base and not more:
        return [], []
    score = [0.0] * (len(base) + len(more))
    of = ((k, w) for k, (a, b) in enumerate([*((a, b) for _, _, b, a in base), *more]) for w in windows(text, a, b))
    while some := list(itertools.islice(of, AT_ONCE)):
        for (k, _), s in zip(some, network.score(np.array([w for _, w in some])).tolist(), strict=True):
            score[k] = max(score[k], s)
    every = [(a, k, b, s) for (a, k, b, _), s in zip(base, score, strict=False)]
    every += [(a, 3, b, s) for (a, b), s in zip(more, score[len(base) :], strict=True) if s >= network.threshold]
    return base, sorted(every)


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


_SPANS = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, scores string"
_NOTHING = hashlib.sha256(b"").hexdigest()


def scan(docs: DataFrame) -> DataFrame:
    """Counts of base matches, the digest of their list, and all spans with their scores, of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def work(batches):
        network = shared.value
        for batch in batches:
            texts = common.column_of(batch, "text")
            data, at = common.utf8(texts)
            n = batch.num_rows
            counts, digest, spans, scores = np.zeros((3, n), np.int64), [_NOTHING] * n, [""] * n, [""] * n
            for first, last in common.steps(at, 8 * common.STEP_BYTES):
                for k in np.flatnonzero(suspects(data[at[first] : at[last]], at[first : last + 1] - at[first])).tolist():
                    base, every = find_spans(texts[first + k].as_py(), network)
                    for _, kind, *_ in base:
                        counts[kind, first + k] += 1
                    digest[first + k] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[first + k] = joined(every)
                    scores[first + k] = ",".join(f"{s:.3f}" for *_, s in every)
            yield pa.RecordBatch.from_arrays([common.column_of(batch, "doc_id"), *(pa.array(c) for c in counts), pa.array(digest), pa.array(spans), pa.array(scores)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"])

    return docs.select("doc_id", common.text_or_empty().alias("text")).mapInArrow(work, _SPANS)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` in ``text``, and ``n_chars`` to match; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    @F.arrow_udf(returnType=T.StringType())
    def cleaned(text: pa.Array) -> pa.Array:
        data, at = common.utf8(text)
        changed = {}
        for first, last in common.steps(at, 8 * common.STEP_BYTES):
            for k in np.flatnonzero(suspects(data[at[first] : at[last]], at[first : last + 1] - at[first])).tolist():
                old = text[first + k].as_py()
                new, end = [], 0
                for a, _, b, _ in find_spans(old, shared.value)[1]:
                    if a >= end:
                        new += [old[end:a], mark]
                    end = max(end, b)
                if end:
                    changed[first + k] = "".join(new) + old[end:]
        if not changed:
            return text
        rows = text.to_pylist()
        for k, new in changed.items():
            rows[k] = new
        return pa.array(rows, pa.string())

    if "n_chars" not in docs.columns:
        return docs.withColumn("text", cleaned("text"))
    new = "_" * (1 + max(len(c) for c in docs.columns))  # a name that no column has
    out = docs.withColumn(new, cleaned("text"))
    out = out.withColumn("n_chars", F.when(F.col(new) != F.col("text"), F.char_length(new)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col(new)).drop(new)
