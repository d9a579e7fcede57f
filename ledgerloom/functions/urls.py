"""URLs: normal form for comparison, validity, sanitised form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.names import stripped


def normalised(url: Column) -> Column:
    """Lower-case host, no trailing slash, fragment or tracking parameters; others keep their order."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, r"^([^:/?#]+://)?([^/?#]*)([^?#]*)", 1)
    host = F.lower(F.regexp_extract(bare, r"^([^:/?#]+://)?([^/?#]*)([^?#]*)", 2))
    path = F.regexp_replace(F.regexp_extract(bare, r"^([^:/?#]+://)?([^/?#]*)([^?#]*)", 3), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(fixed.TRACKING_PARAMETERS))
    rest = F.array_join(kept, "&")
    return F.concat(F.lower(head), host, path, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""))


def is_url(url: Column) -> Column:
    """Not a placeholder, and starts like a web address."""
    low = stripped(F.lower(url))
    none = low.isin(fixed.URL_PLACEHOLDERS) | low.rlike("|".join(fixed.URL_PLACEHOLDER_PARTS))
    return F.coalesce(~none & low.rlike("^(www[.]|http)"), F.lit(False))


def is_website(url: Column) -> Column:
    """A company's own site: not a network, publisher, code host or search page."""
    low = F.lower(url)
    other = low.rlike("|".join(d.replace(".", "[.]") for d in fixed.OTHER_SITES))
    shaped = url.rlike(fixed.SITE_PATTERN) | (low.startswith("www.") & F.concat(F.lit("https://"), url).rlike(fixed.SITE_PATTERN))
    return is_url(url) & ~other & shaped


def is_profile(url: Column) -> Column:
    return F.coalesce(url.rlike(fixed.PROFILE_PATTERN), F.lit(False))


def is_company_page(url: Column) -> Column:
    return F.coalesce(url.rlike(fixed.COMPANY_PAGE_PATTERN), F.lit(False))


def sanitised(url: Column) -> Column:
    """https form of a valid URL, else null."""
    s = stripped(url)
    s = F.when(F.lower(s).startswith("www."), F.concat(F.lit("https://"), s)).otherwise(s)
    return F.when(is_url(url), F.regexp_replace(s, "(?i)^http://", "https://"))


def redirect_target(url: Column) -> Column:
    """The address in a redirect's ``url`` parameter, http and https only."""
    target = F.try_parse_url(url, F.lit("QUERY"), F.lit("url"))
    return F.when(target.rlike("^https?://"), F.try_url_decode(target))


def _decoded(packed: Column) -> Column:
    """Base 64 as text, one character for each byte; what is over at the end is left out."""
    whole = F.substring(packed, F.lit(1), (F.length(packed) - F.when(F.length(packed) % 4 == 1, 1).otherwise(0)).cast("int"))
    padded = F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), F.lit("="))
    return F.decode(F.unbase64(padded), "ISO-8859-1")


def decoded_news_target(url: Column) -> Column:
    """The first address inside the base-64 part of a news redirect, or inside base 64 that stands in that."""
    text = _decoded(F.translate(F.regexp_extract(url, r"/articles/([A-Za-z0-9_-]+)", 1), "-_", "+/"))
    inner = _decoded(F.regexp_extract(text, r"([A-Za-z0-9+/]{20,})", 1))
    address = lambda t: F.nullif(F.regexp_extract(t, r"(https?://[\x21-\x7e]+)", 1), F.lit(""))
    return F.coalesce(address(text), address(inner))
