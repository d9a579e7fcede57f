"""Feeds of landed rows, written as XML by the query and read back by the reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.registry import query
from ledgerloom.plans.views import Views
from ledgerloom.sources import feeds


def _escaped(text):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _feeds(v: Views) -> DataFrame:
    """``feed, xml``: twenty articles a feed, with their texts as marked-up summaries; each seventh feed breaks off, each third is Atom."""
    k, plain = F.col("article_id"), F.col("text")
    at = F.concat(F.date_format("published_date", "yyyy-MM-dd"), F.lit("T"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30:15"))
    atom = F.floor(k / 20) % 3 == 2
    mail = F.concat(F.date_format("published_date", "d MMM yyyy"), F.lit(" "), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30:15 -0500"))
    title = F.when(k % 13 != 5, F.concat(F.lit(" "), _escaped(F.col("title")), F.lit(" "))).otherwise(F.lit("  "))
    summary = _escaped(F.concat(F.lit("<p> "), _escaped(plain), F.lit(" </p>")))
    tag = lambda name, text: F.coalesce(F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>")), F.lit(""))
    rss = F.concat(F.lit("<item>"), tag("title", title), F.when(k % 11 != 3, tag("link", _escaped(F.col("url")))).otherwise(""), tag("description", summary), tag("pubDate", mail), tag("category", F.col("source")), F.lit("</item>"))
    link = F.when(k % 11 != 3, F.concat(F.lit('<link rel="self" href="x"/><link href="'), _escaped(F.col("url")), F.lit('"/>'))).otherwise("")
    entry = F.concat(F.lit("<entry>"), tag("title", title), link, tag("summary", summary), tag("updated", F.concat(at, F.lit("Z"))), F.lit('<category term="'), F.col("source"), F.lit('"/></entry>'))
    items = v.articles.select(F.floor(k / 20).alias("feed"), k.alias("id"), F.when(atom, entry).otherwise(rss).alias("item"))
    joined = items.groupBy("feed").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "item"))), lambda x: x["item"]), "").alias("body"))
    whole = F.when(F.col("feed") % 3 == 2, F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), F.col("body"), F.lit("</feed>"))).otherwise(F.concat(F.lit("<rss><channel><title>all</title>"), F.col("body"), F.lit("</channel></rss>")))
    return joined.select("feed", F.when(F.col("feed") % 7 == 3, F.concat(F.lit("<rss>"), F.col("body"))).otherwise(whole).alias("xml"))


_ENTRIES = """e AS (SELECT article_id, article_id // 20 AS feed, title, url, source, substr(trim(text, ' \t\n\r'), 1, 1000) AS text,
CAST(published_date AS TIMESTAMP) + to_hours(CAST(article_id % 24 + CASE WHEN article_id // 20 % 3 = 2 THEN 0 ELSE 5 END AS INTEGER)) + INTERVAL '30 minutes 15 seconds' AS told FROM articles WHERE article_id % 13 <> 5 AND article_id % 11 <> 3 AND article_id // 20 % 7 <> 3)"""


@query(f"WITH {_ENTRIES} SELECT CAST(feed AS VARCHAR) AS feed, title, url, text, strftime(told, '%Y-%m-%d %H:%M:%S') AS published_at, source AS categories FROM e")
def src05_feed_entries(v: Views) -> DataFrame:
    """Entries of RSS and Atom feeds (SRC-06) with time of day; broken feeds have none, entries without title or link go."""
    found = feeds.entries_of(_feeds(v), "feed", "xml")
    return found.select("feed", "title", "url", "text", F.date_format(F.to_utc_timestamp("published_at", F.current_timezone()), "yyyy-MM-dd HH:mm:ss").alias("published_at"), F.array_join("categories", ",").alias("categories"))


@query(f"""WITH {_ENTRIES}, kept AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY feed, article_id) AS n FROM e WHERE told IS NULL OR told >= TIMESTAMP '2001-06-20 12:00:00')
SELECT url, title, title || CASE WHEN text <> '' THEN chr(10) || chr(10) || text ELSE '' END AS text, coalesce(CAST(told AS DATE), DATE '2001-07-31') AS published_date FROM kept WHERE n = 1""")
def apx06_feed_articles(v: Views) -> DataFrame:
    """Articles of all feeds: the first fresh entry of each address in order of the feeds; undated ones are of today."""
    found = feeds.entries_of(_feeds(v), "feed", "xml").withColumn("published_at", F.to_utc_timestamp("published_at", F.current_timezone()))
    fresh = feeds.fresh_entries(found, F.col("feed").cast("long"), F.lit("2001-07-31 12:00:00").cast("timestamp"), 41 * 24)
    return feeds.feed_articles(fresh, today=F.lit("2001-07-31").cast("date"))
