"""Scores of early signals and registry entities, one expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.text import count_distinct_words, has_any, lowered


def _points(*rules: tuple[Column, int]) -> Column:
    """The points of the first rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for holds, points in rules[1:]:
        out = out.when(holds, points)
    return out.otherwise(0)


def _number(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("long")


def _both(title: Column, text: Column) -> Column:
    return F.concat(lowered(title), F.lit(" "), lowered(text))


def hacker_news(title: Column, text: Column, tags: Column) -> Column:
    """Launch or show post, points, comments, AI, enterprise and funding words; 100 at most."""
    t, low, both = lowered(title), lowered(text), _both(title, text)
    tag = F.coalesce(tags, F.array().cast("array<string>"))
    ai = count_distinct_words(both, fixed.AI_WORDS)
    points, comments = _number(low, r"score[:\s]+(\d+)"), _number(low, r"comments?[:\s]+(\d+)")
    kind = _points((F.array_contains(tag, "launch_hn") | t.contains("launch hn"), 30), (F.array_contains(tag, "show_hn") | t.contains("show hn"), 20))
    total = kind + _points((points >= 200, 25), (points >= 100, 20), (points >= 50, 10)) + _points((comments >= 100, 10)) + _points((ai >= 2, 15), (ai == 1, 8))
    return F.least(F.lit(100), total + _points((has_any(both, fixed.ENTERPRISE_WORDS), 10)) + _points((has_any(both, fixed.FUNDING_WORDS), 5)))


def y_combinator(title: Column, text: Column) -> Column:
    """A base of 40, a batch of 2024 or later, AI and enterprise words."""
    both = _both(title, text)
    ai = count_distinct_words(both, fixed.AI_WORDS)
    year = _number(title, r"(?i)YC\s*[WS](\d{2})")
    return F.least(F.lit(100), 40 + _points((year >= 24, 10)) + _points((ai >= 2, 20), (ai == 1, 10)) + _points((has_any(both, fixed.ENTERPRISE_WORDS), 15)))


def github(title: Column, text: Column) -> Column:
    """Stars of the day and in all, AI and infrastructure words."""
    low, both = lowered(text), _both(title, text)
    ai = count_distinct_words(both, fixed.AI_WORDS)
    stars, total = _number(title, r"(?i)\+(\d+)\s*stars?"), _number(low, r"total\s*stars?[:\s]+(\d+)")
    day = _points((stars >= 200, 30), (stars >= 100, 25), (stars >= 50, 15), (stars.isNotNull(), 5))
    return F.least(F.lit(100), day + _points((total >= 10_000, 10)) + _points((ai >= 2, 20), (ai == 1, 10)) + _points((has_any(both, fixed.ENTERPRISE_WORDS), 15)))


def job_posts(title: Column, text: Column, tags: Column) -> Column:
    """Stealth, a fund behind it, founding and engineering roles, AI words."""
    low, both = lowered(text), _both(title, text)
    tag = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    fund = low.rlike(r"fund[:\s]+[a-z0-9_]+") | F.array_join(tag, " ").contains("fund:")
    total = _points((F.array_contains(tag, "stealth") | both.contains("stealth"), 40)) + _points((fund, 30)) + _points((has_any(both, fixed.FOUNDING_ROLES), 20))
    return F.least(F.lit(100), total + _points((has_any(both, fixed.AI_WORDS), 15)) + _points((has_any(both, fixed.ENGINEERING_ROLES), 10)))


def registry_filing(title: Column, text: Column, tags: Column) -> Column:
    """A startup's agent, a technical name, recent formation, AI in the title."""
    low, both = lowered(text), _both(title, text)
    tag = F.transform(F.coalesce(tags, F.array().cast("array<string>")), F.lower)
    total = _points((F.array_contains(tag, "startup_agent") | has_any(low, fixed.SIGNAL_AGENTS), 35)) + _points((F.array_contains(tag, "tech_name") | both.rlike(fixed.TECH_NAME), 25))
    recent = low.contains("formation date") & has_any(low, fixed.RECENT_WORDS)
    return F.least(F.lit(100), total + _points((recent, 15)) + _points((has_any(lowered(title), fixed.AI_NAME_WORDS), 15)))


def entity(name: Column, agent: Column, formed: Column, as_of) -> Column:
    """Registry entities: technical name 3, startup's agent 5, age 2 or 1, AI in the name 2."""
    age = F.datediff(F.lit(as_of), formed)
    return (
        _points((lowered(name).rlike(fixed.TECH_NAME), 3)) + _points((has_any(lowered(agent), fixed.REGISTRY_AGENTS), 5)) + _points((age <= 30, 2), (age <= 90, 1)) + _points((lowered(name).contains("ai"), 2))
    )


def filing_match(state: Column, first_sale: Column, tech: Column, usd: Column, fund: Column, agent: Column, tech_name: Column) -> Column:
    """Filings matched with the registry: Delaware 2, first sale 3, technology 2, amount 3 to 1, fund 5, agent 5, name 2."""
    amount = _points((usd >= 5_000_000, 3), (usd >= 1_000_000, 2), (usd >= 500_000, 1))
    return _points((state == "DE", 2)) + _points((first_sale, 3)) + _points((tech, 2)) + amount + _points((fund, 5)) + _points((agent, 5)) + _points((tech_name, 2))


def filing_label(score: Column) -> Column:
    return F.when(score >= 10, "HIGH").when(score >= 7, "STRONG")


def dispatched(source: Column, title: Column, text: Column, tags: Column) -> tuple[Column, Column]:
    """The kind of a source, by any of its names, and the score that its kind gives; null for others."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.SIGNAL_SOURCES.items() for x in kv]), source)
    score = F.when(kind == "hackernews", hacker_news(title, text, tags)).when(kind == "ycombinator", y_combinator(title, text)).when(kind == "github", github(title, text))
    return kind, score.when(kind == "linkedin", job_posts(title, text, tags)).when(kind == "delaware", registry_filing(title, text, tags))
