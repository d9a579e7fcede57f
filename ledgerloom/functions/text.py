"""Expressions over texts: keyword tests and counts, white space, fingerprints."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lowered(text: Column, low: Column | None = None) -> Column:
    """A text in lower case, empty for none; ``low`` is a column that has its lower case already, so that long texts aren't lowered for each use."""
    return F.lower(F.coalesce(text, F.lit(""))) if low is None else F.coalesce(low, F.lit(""))


def _alternation(words: list[str]) -> str:
    """A pattern that matches what "one|two|three" of the words does, the first in the list winning.

    Words that begin alike share their beginning, so that a place in a text is tried by letters and not by each word.
    """
    rests: dict[str, list[str]] = {}
    for w in words:
        rests.setdefault(w[:1], []).append(w[1:])
        if w == "":  # nothing after it ever wins
            break
    branches = [re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", first) + (_alternation(after) if first else "") for first, after in rests.items()]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def _pattern(words: list[str]) -> str:
    """The words' pattern, tried only where one of their first letters stands."""
    firsts = sorted({w[:1] for w in words})
    look = "" if "" in firsts or len(firsts) < 2 else f"(?=[{''.join(map(re.escape, firsts))}])"
    return look + _alternation(words)


def has_any(text: Column, words: list[str]) -> Column:
    """Whether a lower-case text contains any of the words, as substrings; one pattern for the whole list."""
    return text.rlike(_pattern(words))


def count_distinct_words(text: Column, words: list[str]) -> Column:
    """How many of the words a lower-case text contains."""
    total = F.lit(0)
    for w in words:
        total = total + text.contains(w).cast("int")
    return total


def count_matches(text: Column, words: list[str]) -> Column:
    """How many non-overlapping matches the words have in a lower-case text, the first in the list winning."""
    return F.regexp_count(text, F.lit(f"({_pattern(words)})"))


def collapsed(text: Column) -> Column:
    """White space of any kind as single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def content_fingerprint(text: Column) -> Column:
    """md5 of a short text, or of the first 500 and last 200 characters of one of 700 or more; empty for no text."""
    one = collapsed(text)
    ends = F.concat(F.substring(one, 1, 500), F.substring(one, -200, 200))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.md5(F.when(F.char_length(one) < 700, one).otherwise(ends)))


def content_hash(text: Column) -> Column:
    """First half of the sha256 of the lower-case text with single blanks."""
    return F.substring(F.sha2(collapsed(F.lower(text)), 256), 1, 32)


def likely_funding_content(text: Column, low: Column | None = None) -> Column:
    """A funding word and an amount word, or three matches of either kind."""
    from ledgerloom.functions import fixed

    low = lowered(text, low)
    strong, amount = count_matches(low, fixed.STRONG_FUNDING), count_matches(low, fixed.AMOUNT_WORDS)
    return ((strong > 0) & (amount > 0)) | (strong + amount >= 3)


@F.pandas_udf(T.StringType())
def shortened(text: pd.Series) -> pd.Series:
    """The beginning of long articles and, as far as there is room, what stands around signs of funding in the rest."""
    from ledgerloom.functions import fixed

    signs = [re.compile(p, re.IGNORECASE) for p in fixed.KEPT_PARTS]

    def one(t: str | None) -> str | None:
        if t is None or len(t) <= fixed.KEPT_CHARACTERS:
            return t
        head = int(fixed.KEPT_CHARACTERS * fixed.KEPT_HEAD)
        out, rest, known = [t[:head]], t[head:], set()
        room = fixed.KEPT_CHARACTERS - head
        for sign in signs:
            for m in sign.finditer(rest):
                around = rest[max(0, m.start() - 100) : m.end() + 100].strip()
                if around[:50] in known:
                    continue
                if len(around) + 10 > room:
                    break
                known.add(around[:50])
                out.append("\n...\n" + around)
                room -= len(out[-1])
        whole = "".join(out)
        return whole + "\n[TRUNCATED]" if len(t) > len(whole) else whole

    return text.map(one)


def cache_key(kind: Column, freshness: Column, count: Column, query: Column) -> Column:
    """The key of a search in the cache of its results."""
    return F.md5(F.concat_ws(":", kind, freshness, count.cast("string"), query))
