"""Feeds read as whole files: what is well-formed, times of day, addresses, and articles made of entries."""

import datetime
import pathlib
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import feeds

UTC = datetime.timezone.utc
D = datetime.datetime
RSS = """<?xml version="1.0" encoding="UTF-8"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>All</title><item><title> T &amp; U </title><link>http://a.b/c</link><pubDate>Thu, 18 Dec 2025 10:01:02 EST</pubDate>
<description>&lt;p&gt;Hello &lt;b&gt; you &lt;/b&gt;&amp;amp; all&lt;/p&gt;</description><category>AI</category><category> </category><category>Data</category><dc:creator>Jane</dc:creator></item>
<item><title>no link</title></item><item><title> </title><link>http://a.b/d</link></item><item><title>By guid</title><guid>http://a.b/e</guid></item><item><title>Not an address</title><guid>77</guid></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link rel="self" href="http://no"/><link href="http://a.b/x"/><author><name>Ann</name></author><updated>2025-12-18T10:00:00+01:00</updated><summary>s</summary></entry></feed>"""


@pytest.mark.parametrize("text, expected", [
    ("Thu, 18 Dec 2025 10:00:00 GMT", D(2025, 12, 18, 10, tzinfo=UTC)), ("18 Dec 2025 23:30:05 -0500", D(2025, 12, 19, 4, 30, 5, tzinfo=UTC)), ("2025-12-18", D(2025, 12, 18, tzinfo=UTC)), ("2025-12-18T10:00Z", D(2025, 12, 18, 10, tzinfo=UTC)),
    ("2025-12-18 10:00:01.55+0530", D(2025, 12, 18, 4, 30, 1, tzinfo=UTC)), ("2025-13-40T00:00:00Z", None), ("soon", None), ("", None), (None, None), ("31 Feb 2025 10:00:00", None),
])
def test_moments(text, expected):
    assert feeds.moment(text) == expected


def test_entries():
    first, second = feeds.entries(RSS)
    assert first == {"title": "T & U", "url": "http://a.b/c", "text": "Helloyou& all", "published_at": D(2025, 12, 18, 15, 1, 2, tzinfo=UTC), "author": "Jane", "categories": ["AI", "Data"]}
    assert (second["title"], second["url"], second["published_at"], second["text"]) == ("By guid", "http://a.b/e", None, "")
    (atom,) = feeds.entries(ATOM.encode())
    assert (atom["url"], atom["published_at"], atom["author"], atom["text"]) == ("http://a.b/x", D(2025, 12, 18, 9, tzinfo=UTC), "Ann", "s")


@pytest.mark.parametrize("xml", [None, "", b"", "no feed", RSS[:-6], RSS.replace("</item>", "", 1), RSS.replace("Hello", "&nbsp;", 1), RSS.replace("T &amp;", "T &", 1), "<rss/>", RSS.encode()[:-1], b"\xff\xfe\x00"])
def test_broken_feeds_have_no_entries(xml):
    assert feeds.entries(xml) == []


def test_long_and_deep_feeds():
    item = "<item><title>t</title><link>http://a.b/{}</link><description>{}</description></item>"
    many = feeds.entries("<rss>" + "".join(item.format(k, "x" * 50) for k in range(20_000)) + "</rss>")
    assert len(many) == 20_000 and many[-1]["url"] == "http://a.b/19999"
    assert len(feeds.entries("<rss>" + item.format(1, "y" * 3_000_000) + "</rss>")[0]["text"]) == feeds.SUMMARY
    deep = "<rss>" + "<a>" * 100_000 + item.format(1, "z") + "</a>" * 100_000 + "</rss>"
    assert [e["url"] for e in feeds.entries(deep)] == ["http://a.b/1"]


def test_files_of_pages(spark, tmp_path):
    """A feed file of each ten pages; every other one breaks off."""
    folder = "/root/testdata/sf0.001"
    if not pathlib.Path(folder).exists():
        pytest.skip("test tables are not here")
    pages = spark.read.parquet(f"{folder}/pages.parquet").where("url IS NOT NULL").select("page_id", "url").collect()
    expected = []
    for k in range(0, len(pages), 10):
        body = "".join(f"<item><title>Page {p['page_id']}</title><link>{escape(p['url'])}</link><pubDate>{k % 27 + 1} Jan 2026 0{k // 10 % 10}:05:06 GMT</pubDate></item>" for p in pages[k : k + 10])
        whole = k // 10 % 2 == 0
        (tmp_path / f"{k:05}.xml").write_text("<rss><channel>" + body + ("</channel></rss>" if whole else ""))
        if whole:
            expected += [(f"{k:05}.xml", j, f"Page {p['page_id']}", p["url"].strip(), D(2026, 1, k % 27 + 1, k // 10 % 10, 5, 6)) for j, p in enumerate(pages[k : k + 10])]
    found = feeds.read_feeds(spark, str(tmp_path))
    got = [(r["feed"].rsplit("/", 1)[-1], r["seq"], r["title"], r["url"], r["published_at"]) for r in found.withColumn("published_at", F.to_utc_timestamp("published_at", "UTC")).collect()]
    assert sorted(r[:4] for r in got) == sorted(r[:4] for r in expected)
    texts = [r["t"] for r in found.select(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("t")).collect()]
    assert sorted(texts) == sorted(r[4].strftime("%Y-%m-%d %H:%M:%S") for r in expected)


def test_no_feeds(spark):
    assert feeds.entries_of(spark.createDataFrame([], "f string, x string"), "f", "x").count() == 0
    assert feeds.entries_of(spark.createDataFrame([("a", None), (None, RSS)], "f string, x string"), "f", "x").count() == 2


def test_fresh_entries_and_articles(spark):
    rows = [("b", 0, "Old", "u1", "s", "2026-01-01 00:00:00"), ("b", 1, "Fresh", "u1", "s", "2026-01-30 00:00:00"), ("a", 5, "First", "u2", "", None), ("b", 2, "Second", "u2", "", "2026-01-31 00:00:00"), ("b", 3, "Edge", "u3", "t", "2026-01-24 12:00:00")]
    found = spark.createDataFrame(rows, "feed string, seq int, title string, url string, text string, at string").withColumn("published_at", F.to_timestamp("at")).drop("at")
    fresh = feeds.fresh_entries(found, F.col("feed"), F.lit("2026-01-31 12:00:00").cast("timestamp"))
    assert {r["url"]: r["title"] for r in fresh.collect()} == {"u1": "Fresh", "u2": "First", "u3": "Edge"}
    texts = spark.createDataFrame([("u1", "landed"), ("u3", "  ")], "url string, text string")
    day = datetime.date(2026, 1, 31)
    kept = {r["url"]: (r["text"], r["published_date"]) for r in feeds.feed_articles(fresh, texts, F.lit(day)).collect()}
    assert kept == {"u1": ("landed", datetime.date(2026, 1, 30)), "u2": ("First", day), "u3": ("Edge\n\nt", datetime.date(2026, 1, 24))}
    assert {r["url"] for r in feeds.feed_articles(fresh).collect()} == {"u1", "u3"}
