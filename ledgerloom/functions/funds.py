"""Tracked funds in investors' names, and investors in texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.names import stripped
from ledgerloom.functions.text import has_any


def _either(words: list[str]) -> str:
    return r"(?U)\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"


def speaks_of_investment(low: Column) -> Column:
    """Whether a lower-case text has a word of investment."""
    return has_any(low, fixed.INVESTMENT_WORDS)


def matched_fund(investor: Column, context: Column | None = None, invests: Column | None = None) -> Column:
    """The tracked fund whose name stands first in an investor's name, unless it only looks like that fund; ties by registry order.

    Where the name or the context speaks of investment, a fund's partners stand for it too, after the funds themselves; ``invests`` says
    whether the context does, so that it is read once for all its names.
    """
    low = stripped(F.lower(investor))
    if context is not None:
        invests = speaks_of_investment(F.coalesce(F.lower(context), F.lit("")))
    invests = speaks_of_investment(low) if invests is None else speaks_of_investment(low) | invests
    rank = {slug: k for k, slug in enumerate(fixed.FUND_NAMES)}

    def found(slug: str, names: list[str], later: int, asked: Column) -> Column:
        # the first name of the list that occurs decides the place
        place = F.coalesce(*[F.nullif(F.regexp_instr(low, F.lit(_either([n]))), F.lit(0)) for n in names])
        other = low.rlike(_either(fixed.NOT_FUNDS[slug])) if slug in fixed.NOT_FUNDS else F.lit(False)
        return F.when(asked & place.isNotNull() & ~other, F.struct(place.alias("place"), F.lit(later).alias("later"), F.lit(rank[slug]).alias("rank"), F.lit(slug).alias("slug")))

    own = [found(slug, names, 0, F.lit(True)) for slug, names in fixed.FUND_NAMES.items()]
    partners = [found(slug, names, 1, invests & own[rank[slug]].isNull()) for slug, names in fixed.PARTNERS.items()]
    # partners are looked for in the order of their own list
    return F.array_min(F.array_compact(F.array(*own, *partners)))["slug"]


def named_in(investor: Column, text: Column) -> Column:
    """Whether a lower-case text names an investor, outside addresses; short names only as whole words, long ones in part too; any name of a fund stands for it."""
    low = F.lower(investor)

    def stands(name: Column) -> Column:
        quoted = F.concat(F.lit(r"(?<![./])"), F.when(F.length(name) < 8, F.lit(r"\b")).otherwise(""), F.lit(r"\Q"), name, F.lit(r"\E"), F.when(F.length(name) < 8, F.lit(r"\b")).otherwise(""), F.lit(r"(?!\.[a-z])"))
        return text.contains(name) & F.regexp_like(text, quoted)  # most texts haven't even the letters

    parts = F.filter(F.split(low, r"\s+"), lambda p: F.length(p) >= 4)
    several = F.size(F.split(low, r"\s+")) > 1
    alias = F.lit(False)
    for names in fixed.FUND_NAMES.values():
        shown = "|".join((rf"(?<![./])\b{re.escape(n)}\b(?!\.[a-z])" if len(n) < 8 else rf"(?<![./]){re.escape(n)}(?!\.[a-z])") for n in names)
        alias = alias | (low.isin(names) & text.rlike(shown))
    return F.coalesce(stands(low) | (several & F.exists(parts, stands)) | alias, F.lit(False))


# all its alternatives begin with a word's start, which is asked once, and only before their first letters
_LEADS = [p.removeprefix(r"\b") for p in fixed.LEAD_LANGUAGE.split("|")]
_LEAD_LANGUAGE = f"(?=[{''.join(sorted({p[0] for p in _LEADS}))}])\\b(?:{'|'.join(_LEADS)})"


def lead_language(text: Column, low: Column | None = None) -> Column:
    return F.coalesce((F.lower(text) if low is None else low).rlike(_LEAD_LANGUAGE), F.lit(False))
