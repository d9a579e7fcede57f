"""RSS and Atom feeds, each file read as a whole: a feed that isn't well-formed has no entries at all, and times keep their time of day.

Files are read by Spark, so that they may lie in any store that it reads; each is parsed in the task that reads it, entry by
entry, and what is parsed of an entry is dropped after it.
"""

from __future__ import annotations

import datetime
import email.utils
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.names import stripped

#: Characters of a summary that are kept.
SUMMARY = 1000
ENTRIES = "feed string, seq int, title string, url string, text string, published_at timestamp, author string, categories array<string>"

_ISO = re.compile(r"(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2})?)(?:\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?)?$", re.IGNORECASE)


class _Strings(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = []

    def handle_data(self, data):
        self.parts.append(data.strip())


def without_marks(html: str) -> str:
    """The strings of a summary, stripped and joined."""
    p = _Strings()
    p.feed(html)
    p.close()
    return "".join(p.parts)


def moment(text: str | None) -> datetime.datetime | None:
    """UTC time of a feed's date: as in mails, or ISO with or without a time; without a zone it is UTC; none if it can't be read."""
    text = (text or "").strip()
    try:
        if iso := _ISO.match(text):
            day, clock, zone = iso.groups()
            offset = "+00:00" if not zone or zone in "Zz" else zone if ":" in zone else zone[:3] + ":" + zone[3:]
            return datetime.datetime.fromisoformat(f"{day}T{clock or '00:00'}{offset}").astimezone(datetime.timezone.utc)
        parsed = email.utils.parsedate_tz(text)
        if parsed is None:
            return None
        at = datetime.datetime(*parsed[:6], tzinfo=datetime.timezone.utc)
        return at - datetime.timedelta(seconds=parsed[9] or 0)
    except (ValueError, OverflowError, TypeError):
        return None


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _entry(e: ET.Element) -> dict | None:
    """One item or entry; none without link or title."""
    found: dict[str, str] = {}
    links, categories = [], []
    for child in e:
        tag, text = _name(child.tag), "".join(child.itertext()).strip()
        if tag == "link":
            links.append((child.get("rel", "alternate") != "alternate", (child.get("href") or text).strip()))
        elif tag == "category":
            categories.append((child.get("term") or text).strip())
        elif tag == "author":
            name = next((c.text for c in child if _name(c.tag) == "name"), None)
            found.setdefault("author", (name or text).strip())
        elif text:
            found.setdefault(tag, text)
    url = next((u for _, u in sorted(links, key=lambda x: x[0]) if u), "")
    if not url and found.get("guid", "").startswith("http"):
        url = found["guid"]
    title = found.get("title", "")
    if not url or not title:
        return None
    when = next((found[k] for k in ("pubdate", "published", "date", "updated") if k in found), None)
    text = next((found[k] for k in ("description", "summary", "encoded", "content") if k in found), "")
    return {
        "title": title, "url": url, "text": without_marks(text)[:SUMMARY], "published_at": moment(when), "author": found.get("author") or found.get("creator"), "categories": [c for c in categories if c],
    }


def entries(xml: str | bytes | None) -> list[dict]:
    """Entries of a feed in order; none at all if it is empty or not well-formed."""
    if not xml:
        return []
    out, parser = [], ET.XMLPullParser(["end"])
    data = xml if isinstance(xml, bytes) else re.sub(r"^\s*<\?xml[^>]*\?>", "", xml.lstrip("﻿")).encode()  # text has no encoding of its own any more
    try:
        for at in range(0, len(data), 1 << 16):
            parser.feed(data[at : at + (1 << 16)])
            for _, e in parser.read_events():
                if _name(e.tag) in ("item", "entry"):
                    if (row := _entry(e)) is not None:
                        out.append(row)
                    e.clear()
        parser.close()
    except (ET.ParseError, ValueError, LookupError):
        return []
    return out


def entries_of(feeds: DataFrame, feed: str, content: str) -> DataFrame:
    """``feed, seq, title, url, text, published_at, author, categories`` of feeds in a column of texts or bytes."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, xml in zip(frame["feed"], frame["content"], strict=True):
                rows = [{"feed": name, "seq": k, **row} for k, row in enumerate(entries(xml))]
                if rows:
                    made = pd.DataFrame(rows)
                    made["published_at"] = pd.to_datetime(made["published_at"], utc=True)
                    yield made

    return feeds.select(F.col(feed).cast("string").alias("feed"), F.col(content).alias("content")).mapInPandas(parse, ENTRIES)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all feed files under a path; ``feed`` is the file's."""
    return entries_of(spark.read.format("binaryFile").load(path), "path", "content")


def fresh_entries(found: DataFrame, rank: Column, now: Column, hours: int = 168) -> DataFrame:
    """Entries that aren't too old, undated ones too, the first of each address in order of the feeds' rank."""
    kept = found.where(F.col("published_at").isNull() | (F.col("published_at") >= now - F.make_interval(hours=F.lit(hours))))
    row = F.struct(*kept.columns)
    return kept.groupBy("url").agg(F.min_by(row, F.struct(rank, F.col("seq"))).alias("e")).select("e.*")


def feed_articles(found: DataFrame, texts: DataFrame | None = None, today: Column | None = None) -> DataFrame:
    """``url, title, text, published_date`` of entries: the landed text of the address (``url, text``), else title and summary.

    Undated ones get ``today``, or go where that is none, as the source asks.
    """
    day = F.to_date("published_at")
    dated = found.withColumn("published_date", day if today is None else F.coalesce(day, today))
    if today is None:
        dated = dated.where("published_date IS NOT NULL")
    own = F.concat_ws("\n\n", "title", F.when(F.col("text") != "", F.col("text")))
    if texts is None:
        return dated.select("url", "title", own.alias("text"), "published_date")
    landed = texts.select("url", F.col("text").alias("landed"))
    full = F.when(stripped(F.coalesce("landed", F.lit(""))) != "", F.col("landed")).otherwise(own)
    return dated.join(landed, "url", "left").select("url", "title", full.alias("text"), "published_date")
