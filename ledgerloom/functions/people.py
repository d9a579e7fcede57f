"""People and companies in search results: profiles, websites, job posts, registry pages, trademarks."""

from __future__ import annotations

import difflib
import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import classify, fixed, pages
from ledgerloom.functions.names import stripped
from ledgerloom.functions.text import has_any, lowered


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over all characters, which no built-in function gives."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def name_of_title(title: Column) -> Column:
    """The person that a profile's title names: what stands before a delimiter, or two capitalised words; roles are no names."""
    t = stripped(F.regexp_replace(F.regexp_replace(title, r"(?i)\s*\|\s*LinkedIn\s*$", ""), r"(?i)\s*-\s*LinkedIn\s*$", ""))

    def before(end: str) -> Column:
        head = stripped(F.substring_index(t, end, 1))
        fits = t.contains(end) & (F.size(_words(head)) >= 2) & (F.char_length(head) < 50) & ~has_any(F.lower(head), fixed.ROLE_WORDS)
        return F.when(fits, head)

    two = F.slice(_words(t), 1, 2)
    real = F.forall(two, lambda w: w.rlike(r"^\p{Lu}") & F.char_length(w).between(2, 15) & ~F.lower(w).isin(fixed.GENERIC_WORDS))
    return F.coalesce(*map(before, fixed.NAME_ENDS), F.when((F.size(two) == 2) & real, F.array_join(two, " ")))


def _company(name: Column) -> Column:
    s = F.regexp_replace(lowered(name), r"\s*(inc\.?|llc|corp\.?|ltd\.?|co\.?|lp)$", "")
    return F.array_join(_words(F.regexp_replace(F.regexp_replace(s, r"\s*ai$", ""), r"(?U)[^\w\s]", "")), " ")


def same_company(profile: Column, expected: Column) -> Column:
    """Equal without legal forms and "AI", one in the other, or nearly alike."""
    a, b = _company(profile), _company(expected)
    given = (F.coalesce(profile, F.lit("")) != "") & (F.coalesce(expected, F.lit("")) != "")
    return F.when(given, (a == b) | b.contains(a) | a.contains(b) | (likeness(a, b) > 0.8)).otherwise(False)


def profile_facts(title: Column, description: Column, known_title: Column) -> Column:
    """``company, title`` of a profile's search result; a title known otherwise stands in if it is a leader's."""
    both = F.concat_ws(" ", title, description)
    company = stripped(_part(both, r"(?:at|@)\s+([A-Za-z][A-Za-z0-9\s&]+)"))
    found = F.coalesce(_part(both, "(?i)" + fixed.PROFILE_TITLES, 0), F.when(classify.leadership(known_title), known_title))
    return F.struct(company.alias("company"), found.alias("title"))


def valid_founder(facts: Column, company: Column) -> Column:
    """Whether a profile is that of a leader of the company."""
    return F.coalesce(same_company(facts["company"], company) & classify.leadership(facts["title"]), F.lit(False))


def profile_link(text: Column) -> Column:
    """The first profile address in a text; placeholders and addresses that are no person's give none."""
    url = _part(text, r"https?://(?:www\.)?linkedin\.com/in/[a-zA-Z0-9_-]{3,}", 0)
    slug = F.regexp_extract(F.lower(url), "/in/([a-z0-9_-]+)", 1)
    none = has_any(lowered(text), ["not mentioned", "not specified", "unknown", "n/a"]) | slug.rlike("(?:" + "|".join(fixed.NO_PEOPLE) + ")$")
    return F.when(~none, F.regexp_replace(url, "^http://", "https://"))


def company_link(text: Column) -> Column:
    """The first company page in a text, unless a page under it follows."""
    m = r"(https?://(?:www\.)?linkedin\.com/company/[a-zA-Z0-9_-]{2,})(?s)(.{0,10})"
    url, after = _part(text, m), F.regexp_extract(text, m, 2)
    return F.when(~has_any(after, ["/jobs", "/posts", "/people", "/about", "/life"]), F.regexp_replace(url, "^http://", "https://"))


def startup_site(url: Column, company: Column) -> Column:
    """Whether a website may be a company's: no known other site, a usual ending, and a name that fits."""
    low, name = F.lower(url), lowered(company)
    domain = F.replace(F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))
    letters = lambda c: F.regexp_replace(c, "[^a-z0-9]", "")
    site, slug = letters(F.substring_index(domain, ".", 1)), letters(name)
    words = F.filter(F.transform(F.split(name, r"(?U)\s+"), letters), lambda w: w != "")
    first = F.coalesce(F.try_element_at(F.filter(words, lambda w: F.length(w) >= 3), F.lit(1)), slug)
    false = functools.reduce(lambda x, y: x | y, [name.contains(k) & has_any(low, parts) for k, parts in fixed.FALSE_SITES.items()])
    health = functools.reduce(lambda x, y: x | y, [site.contains(w) & ~slug.contains(w) for w in fixed.HEALTH_SITES])
    rest = F.replace(site, first, F.lit(""))
    fits = (
        F.when(has_any(domain, fixed.NO_STARTUP_SITES) | false | ~F.substring_index(domain, ".", -1).isin(fixed.SITE_ENDINGS), False)
        .when((F.length(slug) >= 5) & health, False)
        .when(F.length(slug) <= 3, slug == site)
        .when(site.contains(slug) | ((F.length(site) >= 4) & slug.contains(site)), True)
        .when(F.exists(words, lambda w: (F.length(w) >= 2) & (w == site)), True)
        .when((F.length(first) >= 5) & site.contains(first), (F.length(rest) <= 4) | slug.contains(rest))
        .otherwise(False)
    )
    return F.coalesce(F.when(F.trim(name) == "", False).otherwise(fits), F.lit(False))


def _place(text: Column) -> Column:
    return has_any(F.trim(F.lower(text)), fixed.JOB_PLACES)


def _bare(part: Column) -> Column:
    return F.trim(F.substring_index(part, " | ", 1))


def job_company(title: Column) -> Column:
    """The company of a job post's title: after the last "at", between hyphens, after a colon, else the title's beginning; places are none."""
    at = F.split(title, " at ")
    last, second = _bare(F.element_at(at, -1)), _bare(F.try_element_at(at, F.lit(-2)))
    picked = F.when(_place(last) & (F.size(at) > 2), second).otherwise(last)
    by_at = F.when(title.contains(" at ") & ~_place(picked), picked)
    dashed = F.transform(F.split(title, " - "), _bare)
    by_dash = F.try_element_at(F.filter(F.slice(dashed, 2, 1000), lambda x: ~_place(x)), F.lit(1))
    after = F.trim(F.substring_index(title, ":", -1))
    of_after = _bare(F.substring_index(after, " at ", -1))
    by_colon = F.when(title.contains(":"), F.when(~after.contains(" at "), after).when(~_place(of_after), of_after))
    some = lambda x: F.when(x != "", x)
    return F.coalesce(some(by_at), some(by_dash), some(by_colon), F.when(F.char_length(title) > 50, F.concat(F.substring(title, 1, 50), F.lit("..."))).otherwise(title))


def stealth_post(title: Column, text: Column) -> Column:
    both = F.concat(lowered(title), F.lit(" "), lowered(text))
    return has_any(both, fixed.STEALTH_WORDS) & ~has_any(both, fixed.NO_STEALTH)


def registry_result(title: Column, description: Column) -> Column:
    """``entity_name, has_startup_agent`` of a registry search result, or null without a technical name of 2 to 100 characters."""
    both = F.concat_ws(" ", title, description)
    name = F.coalesce(*[F.trim(_part(both, p)) for p in fixed.REGISTRY_NAMES], F.trim(F.regexp_replace(title, fixed.REGISTRY_TITLE_END, "")))
    tech = lowered(name).rlike(fixed.TECH_NAME) | lowered(both).rlike(fixed.TECH_NAME)
    return F.when(F.char_length(name).between(2, 100) & tech, F.struct(name.alias("entity_name"), has_any(lowered(both), fixed.REGISTRY_AGENTS).alias("has_startup_agent")))


def trademark_result(url: Column, title: Column, description: Column) -> Column:
    """``serial_number, mark_text`` of a trademark search result, or null without a mark."""
    serial = F.regexp_extract(F.concat(url, title, description), r"(\d{8})", 1)
    mark = F.trim(F.regexp_replace(F.substring_index(title, " - ", 1), "(?i)USPTO|Trademark|Application|Filing", ""))
    return F.when(F.char_length(mark) >= 2, F.struct(serial.alias("serial_number"), F.substring(mark, 1, 100).alias("mark_text")))


def headline_amount(text: Column) -> Column:
    """The amount in a headline as it is written, by the first kind of notation that occurs."""
    return F.coalesce(*[_part(text, "(?i)" + p, 0) for p in fixed.HEADLINE_AMOUNTS])


def signal_company(title: Column) -> Column:
    """The company that a signal's title begins with, after the kind of signal."""
    tried = [F.trim(F.regexp_extract(title, p, 1)) for p in fixed.SIGNAL_TITLES]
    head = F.trim(F.substring_index(title, " - ", 1))
    return F.coalesce(*[F.when(F.char_length(x) > 1, x) for x in tried], F.when(head != "", head), F.substring(title, 1, 100))


def job_post(title: Column, description: Column) -> Column:
    """Whether a search result counts as a job post of a startup at all."""
    return ~pages.established_company(title, description) & pages.startup_signs(title, description)
