"""Dates: placeholders, relative and absolute expressions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_placeholder(date: Column) -> Column:
    """First days of quarters are mostly defaults."""
    return (F.dayofmonth(date) == 1) & F.month(date).isin(1, 4, 7, 10)


def relative(text: Column, as_of: datetime.date) -> Column:
    """Days, weeks, months of 30 days and years of 365 days ago, yesterday, today; null otherwise."""
    low = F.lower(text)
    day = F.lit(as_of)

    def ago(unit: str, days: int) -> Column:
        n = F.regexp_extract(low, rf"(\d+)\s*{unit}s?\s+ago", 1).try_cast("int")
        return F.date_sub(day, n * days)

    return F.coalesce(ago("day", 1), ago("week", 7), ago("month", 30), ago("year", 365), F.when(low.contains("yesterday"), F.date_sub(day, 1)), F.when(low.contains("today"), day))


def search_age(text: Column, as_of: datetime.date) -> Column:
    """Age of a search result; hours, minutes and anything else count as today."""
    low = F.lower(F.coalesce(text, F.lit("")))
    n = F.coalesce(F.regexp_extract(low, r"(\d+)", 1).try_cast("int"), F.lit(0))
    days = F.when(low.contains("hour") | low.contains("minute"), 0).when(low.contains("day"), n).when(low.contains("week"), 7 * n).when(low.contains("month"), 30 * n).otherwise(0)
    return F.date_sub(F.lit(as_of), days)


def absolute(text: Column) -> Column:
    """ISO dates, month names with day and year in either order, then month/day/year; impossible dates are passed over."""
    month = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    low = F.lower(text)
    iso = F.try_to_date(F.regexp_extract(low, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    number = F.create_map(*[F.lit(x) for k, m in enumerate(month[1:-1].split("|"), 1) for x in (m, f"{k:02d}")])

    def made(pattern: str, y: int, m: int, d: int) -> Column:
        part = lambda g: F.regexp_extract(low, pattern, g)
        mm = F.coalesce(F.try_element_at(number, part(m)), F.lpad(part(m), 2, "0"))
        return F.try_to_date(F.concat_ws("-", part(y), mm, F.lpad(part(d), 2, "0")), "yyyy-MM-dd")

    return F.coalesce(iso, made(month + r"[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})", 3, 1, 2), made(r"(\d{1,2})(?:st|nd|rd|th)?\s+" + month + r"[a-z]*\.?,?\s+(\d{4})", 3, 2, 1), made(r"(\d{1,2})/(\d{1,2})/(\d{4})", 3, 1, 2))


def article_relative(text: Column, day: Column) -> Column:
    """Calendar months and years and weeks ago, last year, earlier this year, as of a day; the first kind in this order."""
    low = F.lower(text)
    n = lambda unit: F.regexp_extract(low, rf"(\d+)\s*{unit}s?\s*ago", 1).try_cast("int")
    year = F.year(day)
    return F.coalesce(
        F.add_months(day, -n("month")), F.add_months(day, -12 * n("year")), F.date_sub(day, 7 * n("week")), F.when(low.rlike(r"last\s+year"), F.add_months(day, -12)),
        F.when(low.rlike(r"earlier\s+this\s+year"), F.make_date(year, F.lit(6), F.lit(1))),
    )


def of_url(url: Column) -> Column:
    """The month in an address with /YYYY/MM/."""
    return F.try_to_date(F.concat_ws("-", F.regexp_extract(url, r"/(\d{4})/(\d{2})/", 1), F.regexp_extract(url, r"/(\d{4})/(\d{2})/", 2), F.lit("01")), "yyyy-MM-dd")


def of_snippet(text: Column, as_of: datetime.date) -> Column:
    """The first date in a snippet, by kind of notation, that lies in the year before a day."""
    month = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?"
    kinds = (month + r"\s+\d{1,2},?\s+\d{4}", r"\d{1,2}\s+" + month + r"\s+\d{4}", r"\d{4}-\d{2}-\d{2}", r"\d{1,2}[/-]\d{1,2}[/-]\d{4}")
    found = [absolute(F.replace(F.regexp_extract(text, "(?i)" + k, 0), F.lit("-"), F.lit("/")) if "/" in k else F.regexp_extract(text, "(?i)" + k, 0)) for k in kinds]
    return F.coalesce(*[F.when(d.between(F.date_sub(F.lit(as_of), 365), F.lit(as_of)), d) for d in found])


def corrected(date: Column, text: Column, published: Column, as_of: datetime.date, low: Column | None = None) -> Column:
    """A date within a week of today gives way to the first relative date of the text, as of its publication, that is over 30 days away."""
    day, low = F.coalesce(published, F.lit(as_of)), F.lower(text) if low is None else low
    year = F.year(day)
    kinds = [
        *(article_relative(F.regexp_extract(low, rf"\d+\s*{unit}s?\s*ago", 0), day) for unit in ("month", "year", "week")), F.when(low.rlike(r"last\s+year"), F.add_months(day, -12)),
        F.when(low.rlike(r"earlier\s+this\s+year"), F.make_date(year, F.lit(6), F.lit(1))), F.when(low.rlike(r"late\s+last\s+year"), F.make_date(year - 1, F.lit(11), F.lit(1))),
        F.when(low.rlike(r"early\s+last\s+year"), F.make_date(year - 1, F.lit(2), F.lit(1))),
    ]
    far = F.coalesce(*[F.when(F.abs(F.datediff(k, date)) > 30, k) for k in kinds])
    return F.when(F.abs(F.datediff(date, F.lit(as_of))) <= 7, F.coalesce(far, date)).otherwise(date)
