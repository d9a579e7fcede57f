"""Tests of funds' own pages, feeds, posts and trademarks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.names import stripped
from ledgerloom.functions.text import count_distinct_words, has_any, lowered


def page_verdict(fund: Column, title: Column, text: Column) -> Column:
    """``excluded`` or ``unverified`` for pages that only look like a fund's, else ``kept``."""
    t, both = lowered(title), F.concat_ws(" ", lowered(title), lowered(text))
    out = F
    for slug, words in fixed.PAGE_EXCLUDES.items():
        out = out.when((fund == slug) & has_any(t if slug in fixed.TITLE_ONLY_PAGES else both, words), "excluded")
    for slug, words in fixed.PAGE_REQUIRES.items():
        out = out.when((fund == slug) & ~has_any(both, words), "unverified")
    return out.otherwise("kept")


def venture_feed(title: Column, text: Column) -> Column:
    """Funding words, and no noise about prices."""
    both = F.concat_ws(" ", lowered(title), lowered(text))
    return ~has_any(both, fixed.CRYPTO_NOISE) & has_any(both, fixed.VENTURE_WORDS)


def funding_post(text: Column) -> Column:
    """Two funding words or more."""
    return count_distinct_words(lowered(text), fixed.POST_WORDS) >= 2


def tech_mark(mark: Column, goods: Column, nice_class: Column) -> Column:
    return has_any(F.concat_ws(" ", lowered(mark), lowered(goods)), fixed.MARK_WORDS) | nice_class.isin(fixed.MARK_CLASSES)


def startup_mark(mark: Column, applicant: Column) -> Column:
    words = F.size(F.filter(F.split(stripped(mark), r"\s+"), lambda w: w != ""))
    return has_any(F.concat_ws(" ", lowered(mark), lowered(applicant)), fixed.MARK_STARTUPS) | words.between(1, 4)


def growth_label(title: Column, text: Column) -> Column:
    both = F.concat_ws(" ", lowered(title), lowered(text))
    return F.when(has_any(both, ["scaleup", "scale up"]), "SCALEUP").when(both.contains("growth"), "GROWTH").when(has_any(both, ["buyout", "acquisition"]), "PE/BUYOUT")


def company_of_title(title: Column) -> Column:
    """The company in "investment in X", "introducing X" and "congrats, X"."""
    name = r"([A-Z][A-Za-z0-9\s]+?)"
    patterns = (rf"(?i)investment\s+in\s+{name}(?:\s*[-:!]|\s*$)", rf"(?i)introducing[:\s]+{name}(?:\s*[-:!]|\s*$)", rf"(?i)congrats?,?\s+{name}(?:\s*[!]|\s*$)")
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(title, p, 1)), F.lit("")) for p in patterns])


def _both(title: Column, text: Column) -> Column:
    return F.concat(lowered(title), F.lit(" "), lowered(text))


def _bounded(words: list[str]) -> str:
    return r"(?U)\b(?:" + "|".join(re.escape(w.lower()) for w in words) + r")\b"


def negative(fund: Column, title: Column, html: Column) -> Column:
    """Whether a page has one of its fund's negative keywords as a word."""
    both, out = _both(title, html), F
    for slug, words in fixed.FUND_NEGATIVES.items():
        out = out.when(fund == slug, both.rlike(_bounded(words)))
    return out.otherwise(False)


def negative_part(fund: Column, text: Column) -> Column:
    """The same by substrings."""
    low, out = lowered(text), F
    for slug, words in fixed.FUND_NEGATIVES.items():
        out = out.when(fund == slug, has_any(low, [w.lower() for w in words]))
    return out.otherwise(False)


def news_excluded(fund: Column, text: Column) -> Column:
    """Whether a news item has a term that its fund's search leaves out."""
    low, out = lowered(text), F
    for slug, words in fixed.NEWS_EXCLUDES.items():
        out = out.when(fund == slug, has_any(low, [w.lower() for w in words]))
    return out.otherwise(False)


def feed_funding(feed: Column, title: Column, text: Column) -> Column:
    """A feed's own funding words; null for a feed that has none."""
    both, out = _both(title, text), F.when(feed == "ventureburn", venture_feed(title, text))
    for name, words in fixed.FEEDS.items():
        out = out.when(feed == name, has_any(both, words))
    return out


def feed_enterprise_ai(feed: Column, title: Column, text: Column) -> Column:
    """Words of enterprise AI, for the feeds that are tagged with it."""
    both = _both(title, text)
    words = F.when(feed == "venturebeat", has_any(both, fixed.VENTUREBEAT_AI_WORDS)).otherwise(has_any(both, fixed.FEED_AI_WORDS))
    return feed.isin(fixed.AI_FEEDS) & words


def wire_names_fund(title: Column, text: Column) -> Column:
    """Tracked funds and partners in press releases; names of two words in either order, short ones as words."""
    turned = [" ".join(reversed(w.split())) for w in fixed.WIRE_NAMES if len(w.split()) == 2]
    both = _both(title, text)
    return has_any(both, [*fixed.WIRE_NAMES, *turned]) | both.rlike(_bounded(fixed.WIRE_SHORT_NAMES))


def established_company(title: Column, text: Column) -> Column:
    """Articles about large companies: the title begins with one, or they will, are, have, or are told about."""
    names = "|".join(re.escape(c) for c in fixed.ESTABLISHED)
    return lowered(title).rlike(f"^(?:{names})") | _both(title, text).rlike(f"(?:{names})(?: will| is|'s)|(?:about|how) (?:{names})")


def startup_signs(title: Column, text: Column) -> Column:
    return has_any(_both(title, text), fixed.STARTUP_SIGNS)


def devtool(name: Column, description: Column) -> Column:
    return has_any(_both(name, description), fixed.DEVTOOL_WORDS)


def batch_enterprise(name: Column, description: Column, industry: Column) -> Column:
    return has_any(F.concat(_both(name, description), F.lit(" "), lowered(industry)), fixed.BATCH_WORDS)


def page_flags(title: Column, text: Column) -> dict[str, Column]:
    """What funds' pages say about an investment."""
    both = _both(title, text)
    return {
        "follow_on": has_any(both, fixed.FOLLOW_ONS), "incubated": has_any(both, fixed.INCUBATIONS), "welcomed": has_any(both, fixed.WELCOMES),
        "ai_focused": has_any(both, fixed.PAGE_AI_WORDS) | both.rlike(_bounded(fixed.PAGE_AI_SHORT)), "forge": has_any(both, ["bvp forge", "bessemer forge"]),
        "leads": F.coalesce(text, F.lit("")).rlike("(?i)" + fixed.PAGE_LEADS), "investment_title": has_any(lowered(title), fixed.INVESTMENT_TITLES),
    }


def region(title: Column, text: Column) -> Column:
    """The region with most of its words, the first of equals; null without any."""
    both = _both(title, text)
    scores = [F.struct(count_distinct_words(both, words).alias("n"), F.lit(-k).alias("rank"), F.lit(name).alias("name")) for k, (name, words) in enumerate(fixed.REGIONS.items())]
    best = F.greatest(*scores)
    return F.when(best["n"] > 0, best["name"])


def well_known(name: Column) -> Column:
    """Companies that everyone knows, and names that begin like theirs."""
    return F.trim(lowered(name)).rlike("^(?:" + "|".join(re.escape(w) for w in fixed.WELL_KNOWN) + ")")


def no_company_name(name: Column) -> Column:
    """Names that stand for none."""
    return F.trim(lowered(name)).isin(fixed.NO_COMPANY)


def made_up_name(name: Column) -> Column:
    """Names that stand for none or that an extractor made up; a missing one isn't made up."""
    low = F.trim(lowered(name))
    return F.when(F.coalesce(name, F.lit("")) == "", False).otherwise(low.isin(fixed.NO_COMPANY) | low.rlike("|".join(fixed.MADE_UP_NAMES)))


def other_vertical(title: Column, tags: Column) -> Column:
    """Articles of verticals that aren't followed, by tag or by title."""
    return F.arrays_overlap(tags, F.array(*map(F.lit, fixed.OTHER_VERTICALS))) | has_any(lowered(title), fixed.OTHER_VERTICALS)
