"""Scan jobs, tracker items, funds, summaries, feeds as sources, and redirects."""

from __future__ import annotations

import base64


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import pages, people, urls
from ledgerloom.functions.funds import matched_fund
from ledgerloom.operators import scans, serving
from ledgerloom.plans.people import cases
from ledgerloom.plans.predicates import varied
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import Views


@query("""SELECT scan_id, CASE WHEN scan_id % 3 = 0 THEN status ELSE 'done' END AS status, CASE WHEN scan_id % 3 <> 0 THEN scan_id % 600 END AS duration_seconds, CASE WHEN scan_id % 3 = 1 THEN deals_saved ELSE 0 END AS deals_saved, CASE WHEN scan_id % 3 = 0 THEN 0 ELSE 7 END AS articles_found FROM scans""")
def apx25_finished_scans(v: Views) -> DataFrame:
    k = F.col("scan_id")
    end = F.timestamp_seconds(F.unix_timestamp("started_at") + k % 600)
    ends = v.scans.where("scan_id % 3 != 0").select("scan_id", end.alias("ended_at"), F.lit("done").alias("status"), F.when(k % 3 == 1, F.col("deals_saved")).alias("deals_saved"), F.lit(7).alias("articles_found"))
    return scans.finished(v.scans, ends)


@query("""WITH r AS (SELECT trigger_name AS source, count(*) FILTER (WHERE deals_saved = 4 AND trigger_name <> 'error') AS deals FROM scans GROUP BY 1), f AS (SELECT slug AS fund, count(*) FILTER (WHERE is_lead) AS deals FROM deal_investors JOIN funds USING (fund_id) WHERE deal_id < 40 GROUP BY 1)
SELECT (SELECT CAST(sum(deals) AS BIGINT) FROM r) AS deals, (SELECT string_agg(source || ': ' || CAST(deals AS VARCHAR), ', ' ORDER BY source || ': ' || CAST(deals AS VARCHAR)) FROM r WHERE deals > 0) AS sources, (SELECT string_agg(fund || ': ' || CAST(deals AS VARCHAR), ', ' ORDER BY fund || ': ' || CAST(deals AS VARCHAR)) FROM f WHERE deals > 0) AS funds""")
def apx28_summary(v: Views) -> DataFrame:
    """What an alert says of a run: sources and funds that had deals."""
    results = v.scans.groupBy(F.col("trigger_name").alias("source")).agg(F.count_if((F.col("deals_saved") == 4) & (F.col("trigger_name") != "error")).alias("deals"))
    funds = v.deal_investors.where("deal_id < 40").join(v.funds, "fund_id").groupBy(F.col("slug").alias("fund")).agg(F.count_if("is_lead").alias("deals"))
    return scans.summary(results, funds)


@query("SELECT id AS article_id, k.place, CASE WHEN k.place IS NOT NULL THEN 'Deal ' || CAST(k.place AS VARCHAR) END AS deal FROM landed_rows JOIN (VALUES (0, 0), (0, 1), (1, 0), (2, NULL)) k(kind, place) ON id % 3 = k.kind")
def apx27_deals_of_batches(v: Views) -> DataFrame:
    """Deals of articles that announce several, in order; a failed extraction keeps its article."""
    k = F.col("id") % 3
    deals = F.when(k == 0, F.array(F.lit("Deal 0"), F.lit("Deal 1"))).when(k == 1, F.array(F.lit("Deal 0")))
    return scans.deals_in_order(v.landed_rows.select(F.col("id").alias("article_id"), deals.alias("deals")))


@query("SELECT item_id, status, CASE WHEN item_id % 4 = 1 THEN 'New name' ELSE company_name END AS company_name, CASE WHEN item_id % 4 = 2 THEN NULL ELSE 'old' END AS notes FROM tracker")
def apx23_updated_items(v: Views) -> DataFrame:
    """Changes of tracker items: of two the last, an empty value counts, and the status can't be changed this way."""
    items = v.tracker.select("item_id", "status", "company_name", F.lit("old").alias("notes"))
    k = F.col("item_id") % 4
    one = items.select("item_id", F.lit(1).alias("seq"), F.when(k == 0, "status").when(k == 1, "company_name").when(k == 2, "notes").otherwise("unknown").alias("field"), F.lit("first").alias("value"))
    two = items.select("item_id", F.lit(2).alias("seq"), F.when(k == 0, "status").when(k == 1, "company_name").when(k == 2, "notes").otherwise("deal_id").alias("field"), F.when(k != 2, "New name").alias("value"))
    return serving.updated_items(items, one.unionByName(two))


@query("SELECT slug, fund_name FROM funds WHERE fund_id % 2 = 0 UNION ALL SELECT slug, 'Fund of ' || slug FROM funds WHERE fund_id % 2 = 1")
def apx24_funds(v: Views) -> DataFrame:
    """Funds after some are asked for by name: those that are there stay as they are, others are made once."""
    wanted = v.funds.select("slug", F.concat(F.lit("Fund of "), "slug").alias("fund_name"))
    return serving.with_funds(v.funds.where("fund_id % 2 = 0"), wanted.unionByName(wanted))


_HEAD, _HEAD_SQL = cases(("Sequoia Capital and Accel", "sequoia"), ("a round by Bill Gurley", "benchmark"), ("a talk of Bill Gurley", None), ("a16z crypto invests", None), ("Thrive Capital leads with GV", "thrive"), ("nobody", None), ("Andreessen Horowitz; Thrive Market", "a16z"))


@query(f"SELECT id, {_HEAD_SQL} AS fund FROM landed_rows")
def apx15_funds_in_headlines(v: Views) -> DataFrame:
    """The fund that stands first in a headline; partners only where it speaks of investment."""
    return v.landed_rows.select("id", matched_fund(_HEAD()).alias("fund"))


_THRIVE, _THRIVE_SQL = cases(
    ("Thrive Capital backs Acme", True), ("Thrive Market grows", False), ("Acme raises", False), ("led by Thrive and others", True),
)
_FULL = ["thrive capital is in", "thrive global too", "no such fund"]


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN 'thrive capital is in' ELSE '' END AS text FROM landed_rows WHERE {_THRIVE_SQL}")
def apx03_feed_pages(v: Views) -> DataFrame:
    """Feeds as a fund's source: items that the fund's rules leave; a text that they don't leave is blank."""
    kept = v.landed_rows.where(pages.page_verdict(F.lit("thrive"), _THRIVE(), F.lit("")) == "kept")
    full = varied("id", _FULL)[0]()
    return kept.select("id", F.when(pages.page_verdict(F.lit("thrive"), F.lit(""), full) == "kept", full).otherwise("").alias("text"))


_JT, _JD, _JOB_SQL = cases(
    ("Founding Engineer at Nova", "stealth, backed by Accel", "Nova"), ("Amazon raises wages", "stealth", None), ("Engineer at Beta", "plain work", None), ("Zed launches from stealth", "", "Zed launches from stealth"),
)


@query(f"SELECT id, {_JOB_SQL} AS company_name, id % 4 = 0 OR id % 4 = 3 AS is_stealth, CASE WHEN id % 4 = 0 THEN 'accel' END AS fund FROM landed_rows WHERE id % 4 IN (0, 3)")
def src21_job_posts(v: Views) -> DataFrame:
    """Job posts of landed searches: of startups alone, with company, stealth and fund."""
    rows = v.landed_rows.select("id", _JT().alias("title"), _JD().alias("description")).where(people.job_post(F.col("title"), F.col("description")))
    return rows.select("id", people.job_company(F.col("title")).alias("company_name"), people.stealth_post(F.col("title"), F.col("description")).alias("is_stealth"), matched_fund(F.concat_ws(" ", "title", "description")).alias("fund"))


@query("""SELECT id, 'Entity ' || CAST(id AS VARCHAR) AS entity_name, CASE WHEN id % 2 = 0 THEN DATE '2001-05-01' END AS formation_date FROM landed_rows WHERE id % 3 <> 2""")
def src13_registry_answers(v: Views) -> DataFrame:
    """Entities of registry answers; answers that failed have none."""
    k = F.col("id")
    company = F.struct(F.concat(F.lit("Entity "), k.cast("string")).alias("name"), F.when(k % 2 == 0, "2001-05-01").otherwise("").alias("incorporation_date"))
    answer = F.when(k % 3 == 2, "too many requests").otherwise(F.to_json(F.struct(F.struct(F.array(F.struct(company.alias("company"))).alias("companies")).alias("results"))))
    schema = "results struct<companies:array<struct<company:struct<name:string,incorporation_date:string>>>>"
    found = v.landed_rows.select("id", F.explode(F.from_json(answer, schema)["results"]["companies"]).alias("c"))
    return found.select("id", F.col("c.company.name").alias("entity_name"), F.try_to_date("c.company.incorporation_date", "yyyy-MM-dd").alias("formation_date"))


def _packed(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


_OLD = "https://news.google.com/rss/articles/" + _packed(b"\x08\x13\x22\x28https://example.com/a/long/article-name\xd2\x01\x00") + "?oc=5"
_TWICE = "https://news.google.com/rss/articles/" + _packed(b"\x01\x02" + base64.b64encode(b"\x00https://example.org/another/article") + b"\x00")


@query("SELECT id, CASE id % 3 WHEN 0 THEN 'https://example.com/a/long/article-name' WHEN 1 THEN 'https://example.org/another/article' END AS target FROM landed_rows")
def src22_news_targets(v: Views) -> DataFrame:
    """Addresses in news redirects, packed once or twice."""
    return v.landed_rows.select("id", urls.decoded_news_target(varied("id", [_OLD, _TWICE, "https://news.google.com/home"])[0]()).alias("target"))



@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'd' ELSE 's' END AS kind FROM landed_rows WHERE id % 10 = 3")
def apx24_rows_by_id(v: Views) -> DataFrame:
    """Rows looked up by their ids."""
    wanted = v.landed_rows.where("id % 10 = 3").select("id")
    return v.landed_rows.join(wanted, "id", "left_semi").select("id", F.when(F.col("id") % 2 == 0, "d").otherwise("s").alias("kind"))
