"""Company and person names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed

#: A run of suffixes up to the end; it is tried only where one of their first characters stands.
_SUFFIX_RUN = "(?=[" + re.escape("".join(sorted({s[0] for s in fixed.NAME_SUFFIXES}))) + "])(?:" + "|".join(re.escape(s) for s in fixed.NAME_SUFFIXES) + r")+\z"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def normal_form(name: Column) -> Column:
    """Lower case without a leading "the", company suffixes and anything but letters and digits."""
    low = F.regexp_replace(stripped(F.lower(name)), r"^the ", "")
    return F.regexp_replace(F.regexp_replace(low, _SUFFIX_RUN, ""), "[^a-z0-9]", "")


def block_keys(norm: Column) -> Column:
    """Keys under which two matching names surely meet: the normal form, and it less each suffix it may have over another."""
    cut = []
    for s in fixed.MATCH_SUFFIXES:
        cut.append(F.when(norm.endswith(s) & (F.length(norm) >= len(s) + 3), F.substring(norm, F.lit(1), F.length(norm) - len(s))))
    return F.array_distinct(F.array_compact(F.array(norm, *cut)))


def names_match(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Equal normal forms, or one that is the other and a known suffix; names without a normal form are compared as they are."""
    shorter = F.when(F.length(norm_a) <= F.length(norm_b), norm_a).otherwise(norm_b)
    longer = F.when(F.length(norm_a) <= F.length(norm_b), norm_b).otherwise(norm_a)
    rest = F.substring(longer, F.length(shorter) + 1, F.length(longer))
    extended = (F.length(shorter) >= 3) & longer.startswith(shorter) & rest.isin(fixed.MATCH_SUFFIXES)
    raw = stripped(F.lower(a)) == stripped(F.lower(b))
    return F.when((norm_a == "") & (norm_b == ""), raw).when((norm_a == "") | (norm_b == ""), False).otherwise((norm_a == norm_b) | extended)


def slug(title: Column) -> Column:
    """Lower case, white space and hyphens as underscores, nothing but letters, digits and inner underscores."""
    s = F.regexp_replace(F.lower(title), r"(?U)[\s-]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9_]", ""), "^_+|_+$", "")
    return F.when(s == "", "column").otherwise(s)


def looks_like_title(name: Column) -> Column:
    """Whether a company's name is really an article's title."""
    from ledgerloom.functions.text import has_any

    low = stripped(F.lower(name))
    words = F.size(F.filter(F.split(stripped(name), r"(?U)\s+"), lambda w: w != ""))
    found = F.lit(False)
    for p in fixed.TITLE_PATTERNS:
        found = found | low.rlike(p)
    return F.coalesce((F.length(name) < 3) | found | (words > 4) | has_any(low, fixed.TITLE_PARTS), F.lit(True))


def person_names_match(a: Column, b: Column) -> Column:
    """First names where one starts the other, and equal last names."""
    x, y = (F.split(stripped(F.lower(n)), r"(?U)\s+") for n in (a, b))
    first = F.element_at(x, 1).startswith(F.element_at(y, 1)) | F.element_at(y, 1).startswith(F.element_at(x, 1))
    last = F.element_at(x, -1) == F.element_at(y, -1)
    both = (F.size(x) > 1) & (F.size(y) > 1)
    return F.coalesce(F.when((stripped(a) == "") | (stripped(b) == ""), False).when(both, first & last).otherwise(first), F.lit(False))


def profile_name(url: Column) -> Column:
    """First and last name from a profile's address, or null."""
    slug = F.regexp_extract(F.lower(url), r"(?:^|[\s/:])(?:www\.)?linkedin\.com/in/([a-z0-9_-]+)", 1)
    parts = F.filter(F.split(slug, "-"), lambda p: (F.length(p) > 1) & ~p.isin(fixed.NO_NAMES) & ~p.rlike(r"^\d+$"))
    return F.when(F.size(parts) >= 2, F.concat_ws(" ", F.initcap(F.element_at(parts, 1)), F.initcap(F.element_at(parts, 2))))
