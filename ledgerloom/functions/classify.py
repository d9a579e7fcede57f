"""Classifiers of extracted deals; each gives the reason of its first rule that holds, or null.

``low`` is a column that has the text's lower case already, where there is one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.text import count_distinct_words, count_matches, has_any, lowered


def crypto(name: Column, description: Column, text: Column, fund: Column, leads: Column, low: Column | None = None) -> Column:
    """Why a deal is about crypto; ``leads`` is an array of names."""
    n, d, t = lowered(name), lowered(description), lowered(text, low)
    ai = has_any(t, fixed.AI_IN_CRYPTO_TEXT)
    hits = count_matches(t, fixed.CRYPTO_WORDS)
    return (
        F.when(has_any(n, fixed.KNOWN_CRYPTO), "known")
        .when(has_any(n, fixed.CRYPTO_NAMES), "name")
        .when(n.rlike(fixed.CRYPTO_NAME_WORDS), "name word")
        .when(has_any(d, fixed.CRYPTO_WORDS) & ~has_any(d, fixed.AI_IN_DESCRIPTION), "description")
        .when(hits >= F.when(ai, 6).otherwise(4), "density")
        .when(has_any(t, fixed.CRYPTO_LABELS) & ~ai, "label")
        .when(lowered(fund).contains("crypto"), "fund")
        .when(F.exists(F.coalesce(leads, F.array().cast("array<string>")), lambda x: F.coalesce(F.lower(x).contains("crypto"), F.lit(False))), "lead")
    )


def consumer_fintech(name: Column, description: Column, text: Column, low: Column | None = None) -> Column:
    n, d, t = lowered(name), lowered(description), lowered(text, low)
    words = count_distinct_words(t, fixed.FINTECH_WORDS)
    plain = ~has_any(t, fixed.AI_IN_FINTECH_TEXT)
    return (
        F.when(has_any(n, fixed.KNOWN_FINTECH), "known")
        .when(has_any(n, fixed.FINTECH_NAMES) & (words >= 2) & plain, "name")
        .when((words >= 3) & plain, "density")
        .when(has_any(d, fixed.FINTECH_DESCRIPTIONS), "description")
    )


def consumer_ai(name: Column, description: Column, text: Column, category: Column, low: Column | None = None) -> Column:
    n, d, t = lowered(name), lowered(description), lowered(text, low)
    business = has_any(d, fixed.ENTERPRISE_DESCRIPTIONS)
    return (
        F.when(category.isin(fixed.CONSUMER_CATEGORIES), "category")
        .when(has_any(n, fixed.CONSUMER_NAMES) & ~business, "name")
        .when(count_distinct_words(t, fixed.CONSUMER_WORDS) >= 3, "density")
        .when(has_any(d, fixed.CONSUMER_DESCRIPTIONS) & ~business, "description")
    )


def grounded_category(category: Column, text: Column, description: Column, low: Column | None = None) -> Column:
    """A category outside AI, or ``other`` if neither text nor description has a word of it."""
    both = F.concat_ws("\n", lowered(text, low), lowered(description))
    out = F
    for c, words in fixed.CATEGORY_WORDS.items():
        out = out.when((category == c) & ~has_any(both, words), "other")
    return out.otherwise(category)


def background_mention(name: Column, text: Column, external: Column, low: Column | None = None) -> Column:
    """Whether a company occurs only after an article's headline area."""
    company, t = F.trim(F.lower(name)), F.coalesce(text, F.lit(""))
    n = F.length(t)
    line = F.instr(t, "\n") - 1
    area = F.when(n < 1000, F.greatest(F.lit(200), F.floor(n * 0.4).cast("int"))).when(line < 0, 500).otherwise(F.greatest(line, F.lit(500)))
    head = F.substring(lowered(text, low), F.lit(1), area)
    first = F.element_at(F.split(company, r"\s+"), 1)
    missing = ~head.contains(company) & (F.length(first) >= 4) & ~head.contains(first)
    return F.coalesce(~external & (n >= 500) & (company != "") & missing, F.lit(False))


def source_skip(source: Column, url: Column, title: Column) -> Column:
    """Why a source's page never announces funding; the first rule wins."""
    s, u, t = lowered(source), lowered(url), lowered(title)
    return (
        F.when(((s == "crunchbase") | u.contains("crunchbase.com")) & has_any(u, fixed.CRUNCHBASE_PAGES), "crunchbase page")
        .when(((s == "ycombinator") | u.contains("ycombinator.com")) & has_any(u, fixed.YC_PAGES), "yc page")
        .when(((s == "ycombinator") | u.contains("ycombinator.com")) & has_any(t, fixed.YC_TITLES), "yc title")
        .when(((s == "hackernews") | u.contains("news.ycombinator.com")) & t.contains("show hn:") & ~t.contains("funding") & ~t.contains("raise"), "hn show")
        .when(u.contains("linkedin.com") & has_any(u, fixed.LINKEDIN_PAGES), "linkedin page")
    )


def no_announcement(title: Column) -> Column:
    return has_any(lowered(title), fixed.NO_ANNOUNCEMENT)


def likely_funding(title: Column) -> Column:
    """A strong sign or two weak ones; a missing title passes."""
    t = lowered(title)
    return (t == "") | has_any(t, fixed.STRONG_TITLE) | (count_distinct_words(t, fixed.WEAK_TITLE) >= 2)


def crypto_site(url: Column) -> Column:
    return has_any(lowered(url), fixed.CRYPTO_SITES)


def fund_structure(name: Column, text: Column, usd: Column, low: Column | None = None) -> Column:
    """Why a startup's name is really that of a fund or its vehicle."""
    from ledgerloom.functions.funds import matched_fund

    n = F.lower(name)
    return (
        F.when(n.rlike(fixed.FUND_NAME_END), "fund name")
        .when(n.rlike(fixed.SPECIAL_VEHICLE), "special vehicle")
        .when(n.rlike(r",\s*(lp|llc|llp)$"), "legal form")
        .when(name.rlike(r"^[A-Z]{2,4}-\d{3,}") & n.contains("fund"), "fund code")
        .when(matched_fund(name).isNotNull(), "tracked fund")
        .when((usd >= 1_000_000_000) & has_any(lowered(text, low), fixed.FUND_RAISES), "fund raise")
    )


def ai_of_industries(industries: Column, description: Column) -> Column:
    """``is_ai, is_enterprise, category`` of an export's deal; the first kind of industry that it has decides."""
    low = F.transform(F.coalesce(industries, F.array().cast("array<string>")), lambda x: F.trim(F.lower(x)))
    d = lowered(description)
    has = lambda kind: F.exists(low, lambda x: has_any(x, fixed.INDUSTRIES[kind]))
    out = lambda ai, enterprise, category: F.struct(F.lit(ai).alias("is_ai"), F.lit(enterprise).alias("is_enterprise"), F.lit(category).alias("category"))
    ai = has("ai") | ((d != "") & has_any(d, fixed.AI_IN_EXPORT))
    result = F.when(has("crypto") | ~ai, out(False, False, "not_ai")).when(has("consumer"), out(True, False, "not_ai"))
    for kind in ("security", "vertical_saas", "data_intelligence", "infrastructure"):
        result = result.when(has(kind), out(True, True, kind))
    software = F.exists(low, lambda x: has_any(x, ["software", "developer"]))
    return result.when(has_any(d, fixed.ENTERPRISE_IN_EXPORT) | software, out(True, True, "infrastructure")).otherwise(out(True, False, "not_ai"))


def obvious_fund(name: Column) -> Column:
    """Filers that are funds for sure."""
    return lowered(name).rlike(r"\bspv[\s\-]?[0-9ivxlc]*\b|\bfund\s*[ivxlc0-9]+")


def likely_backed(industry: Column, raised: Column, offering: Column, first_sale: Column) -> Column:
    """Filings of a likely industry that raised enough or sell for the first time; amounts that aren't whole numbers count as none."""
    digits = F.regexp_replace(F.when(F.coalesce(raised, F.lit("")) != "", raised).otherwise(offering), "[$,]", "")
    enough = F.coalesce(F.trim(digits).try_cast("long") >= fixed.BACKED_AMOUNT, F.lit(False))
    return has_any(lowered(industry), fixed.BACKED_INDUSTRIES) & (enough | first_sale)


def leadership(title: Column) -> Column:
    return has_any(lowered(title), fixed.LEADERS)


def sanitised_value(value: Column, most: int = 500) -> Column:
    """Text that can stand in a prompt: no control characters, fences or role markers, cut to length."""
    gap = "​"
    s = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    s = F.regexp_replace(F.replace(s, F.lit("```"), F.lit(f"`{gap}`{gap}`")), "---", f"-{gap}-{gap}-")
    s = F.regexp_replace(s, r"(?i)(SYSTEM|USER|ASSISTANT):", f"$1{gap}:")
    s = F.regexp_replace(s, r"(?i)<(/?)(instructions|system|prompt)", f"<$1{gap}$2")
    return F.regexp_replace(F.when(F.char_length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s), r"(?U)^\s+|\s+\z", "")
