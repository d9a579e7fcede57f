"""Pages of lists, changes of stored tables, caches and merges."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import names
from ledgerloom.operators import scans, serving
from ledgerloom.plans.dedup import norm_sql
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import AS_OF, Views

_TRACKED = "deal_id IN (SELECT deal_id FROM deal_investors WHERE is_lead AND is_tracked_fund)"
_ORDER = "announced_date DESC NULLS LAST, created_date DESC, deal_id"


def named_deals(v: Views) -> DataFrame:
    return v.deals.join(v.companies.select("company_id", "name", "website"), "company_id")


def fund_rows(v: Views) -> DataFrame:
    return v.deal_investors.join(v.funds, "fund_id").select("deal_id", "slug", "fund_name", "is_lead", "is_tracked_fund", "position", "fund_id")


def _page_sql(where: str, order: str, offset: int, limit: int) -> str:
    return f"""WITH f AS (SELECT d.*, c.name FROM deals d JOIN companies c USING (company_id)), m AS (SELECT * FROM f WHERE {where}), n AS (SELECT count(*) AS total FROM m)
SELECT m.deal_id, m.name, m.announced_date, n.total, n.total > {offset + limit} AS has_more FROM m, n ORDER BY {order} LIMIT {limit} OFFSET {offset}"""


def _page(rows: DataFrame, offset: int, limit: int, descending: bool = True) -> DataFrame:
    return serving.deals_page(rows, offset, limit, descending).select("deal_id", "name", "announced_date", "total", "has_more")


@query(_page_sql(f"round_type = 'series_a' AND {_TRACKED} AND is_ai_deal AND NOT is_enterprise_ai AND enterprise_category = 'category_1' AND name ILIKE '%company%' AND deal_id IN (SELECT deal_id FROM deal_investors JOIN funds USING (fund_id) WHERE regexp_matches(slug, '^fund_[1-4]'))", _ORDER, 0, 20))
def qry01_all_filters(v: Views) -> DataFrame:
    """All seven filters at once, the fund as any of a group."""
    rows = fund_rows(v)
    nine = rows.where(F.col("slug").rlike("^fund_[1-4]")).withColumn("slug", F.lit("nine")).unionByName(rows)
    found = serving.filtered_deals(named_deals(v), nine, round_type="series_a", led=True, is_ai=True, is_enterprise=False, category="category_1", fund="nine", name="company")
    return _page(found, 0, 20)


@query(_page_sql(f"NOT {_TRACKED} AND is_enterprise_ai", "announced_date ASC NULLS FIRST, created_date ASC, deal_id", 30, 25))
def qry01_oldest_unled(v: Views) -> DataFrame:
    return _page(serving.filtered_deals(named_deals(v), fund_rows(v), led=False, is_enterprise=True), 30, 25, descending=False)


@query(_page_sql("deal_id IN (SELECT deal_id FROM deal_investors JOIN funds USING (fund_id) WHERE slug = 'fund_7')", _ORDER, 0, 50))
def qry01_deals_of_fund(v: Views) -> DataFrame:
    return _page(serving.filtered_deals(named_deals(v), fund_rows(v), fund="fund_7"), 0, 50)


@query("""WITH l AS (SELECT deal_id, arg_min(fund_name, position * 1000000 + fund_id) AS lead FROM deal_investors JOIN funds USING (fund_id) WHERE is_lead AND is_tracked_fund GROUP BY deal_id)
SELECT d.deal_id, c.name AS "Company", d.round_type AS "Round", coalesce(CAST(d.amount_usd AS VARCHAR), 'Undisclosed') AS "Amount", coalesce(strftime(d.announced_date, '%Y-%m-%d'), '') AS "Date", coalesce(l.lead, '') AS "Lead Investor",
CASE WHEN l.lead IS NULL THEN '' ELSE 'Partner of ' || l.lead END AS "Lead Partner", coalesce(d.enterprise_category, '') AS "Enterprise Category", CASE WHEN d.is_enterprise_ai THEN 'Yes' ELSE 'No' END AS "Is Enterprise AI", coalesce(d.founders_json, '') AS "Verification Snippet"
FROM deals d JOIN companies c USING (company_id) LEFT JOIN l USING (deal_id) WHERE d.round_type = 'seed'""")
def snk07_export_rows(v: Views) -> DataFrame:
    """The nine columns of an export, and the deal that each row is."""
    lead = fund_rows(v).where("is_lead AND is_tracked_fund").groupBy("deal_id").agg(F.min_by("fund_name", F.struct("position", "fund_id")).alias("lead"))
    rows = serving.filtered_deals(named_deals(v), fund_rows(v), round_type="seed").join(lead, "deal_id", "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        "deal_id", F.col("name").alias("Company"), F.col("round_type").alias("Round"), F.coalesce(F.col("amount_usd").cast("string"), F.lit("Undisclosed")).alias("Amount"), blank(F.date_format("announced_date", "yyyy-MM-dd")).alias("Date"),
        blank(F.col("lead")).alias("Lead Investor"), blank(F.concat(F.lit("Partner of "), "lead")).alias("Lead Partner"), blank(F.col("enterprise_category")).alias("Enterprise Category"),
        F.when(F.col("is_enterprise_ai"), "Yes").otherwise("No").alias("Is Enterprise AI"), blank(F.col("founders_json")).alias("Verification Snippet"),
    )


_DETECTED = "'https://fund.com/' || CAST(id % 90 AS VARCHAR)"


@query(f"SELECT min(id) AS id, {_DETECTED} AS detected_url, min(id % 5) AS fund, (SELECT count(DISTINCT id % 90) FROM landed_rows WHERE id % 90 % 5 = 2) AS total FROM landed_rows WHERE id % 90 % 5 = 2 GROUP BY 2 ORDER BY id DESC LIMIT 10 OFFSET 3")
def qry07_detections_page(v: Views) -> DataFrame:
    """Detections of one fund, newest first, with their number."""
    rows = v.landed_rows.where("id % 90 % 5 = 2").groupBy(F.concat(F.lit("https://fund.com/"), (F.col("id") % 90).cast("string")).alias("detected_url")).agg(F.min("id").alias("id"), F.min(F.col("id") % 5).alias("fund"))
    return rows.orderBy(F.desc("id")).offset(3).limit(10).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query(f"""WITH r AS (SELECT {_DETECTED} AS detected_url, CASE id % 2 WHEN 0 THEN 'accel' ELSE 'usv' END AS fund_slug, CASE WHEN id % 3 = 0 THEN NULL ELSE author || CAST(id AS VARCHAR) END AS company_name, CASE WHEN id % 4 = 0 THEN NULL ELSE 'note ' || CAST(id AS VARCHAR) END AS notes, CASE WHEN id < 90 THEN -1 ELSE id END AS seq FROM landed_rows WHERE id >= 90 OR id % 2 = 0)
SELECT detected_url, arg_min(fund_slug, seq) AS fund_slug, arg_min(company_name, seq) FILTER (WHERE company_name IS NOT NULL) AS company_name, arg_min(notes, seq) FILTER (WHERE notes IS NOT NULL) AS notes FROM r GROUP BY 1""")
def snk04_upserted_detections(v: Views) -> DataFrame:
    k = F.col("id")
    rows = v.landed_rows.select(
        "id", k.alias("seq"), F.concat(F.lit("https://fund.com/"), (k % 90).cast("string")).alias("detected_url"), F.when(k % 2 == 0, "accel").otherwise("usv").alias("fund_slug"),
        F.when(k % 3 != 0, F.concat("author", k.cast("string"))).alias("company_name"), F.when(k % 4 != 0, F.concat(F.lit("note "), k.cast("string"))).alias("notes"),
    )
    return serving.upserted_detections(rows.where("id < 90 AND id % 2 = 0"), rows.where("id >= 90"))


@query("SELECT fund_slug, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM snapshots s WHERE side = CASE WHEN (SELECT count(*) FROM snapshots c WHERE c.fund_slug = s.fund_slug AND c.side = 'cur') > 0 THEN 'cur' ELSE 'prev' END GROUP BY fund_slug")
def snk05_latest_snapshots(v: Views) -> DataFrame:
    listed = lambda side: v.snapshots.where(F.col("side") == side).groupBy("fund_slug").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return serving.latest_snapshots(listed("prev"), listed("cur"))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 50 AS batch FROM usage")
def snk06_usage_batches(v: Views) -> DataFrame:
    return serving.usage_batches(v.usage.select(F.col("event_id").alias("seq")), 50).select(F.col("seq").alias("event_id"), "batch")


@query("""WITH gone AS (SELECT deal_id FROM deals WHERE deal_id % 13 = 5), l AS (SELECT signal_id, converted_deal_id AS d FROM signals)
SELECT 'deals' AS name, count(*) AS n, CAST(sum(deal_id) AS BIGINT) AS checksum FROM deals WHERE deal_id NOT IN (SELECT deal_id FROM gone) UNION ALL SELECT 'investors', count(*), CAST(sum(deal_id) AS BIGINT) FROM deal_investors WHERE deal_id NOT IN (SELECT deal_id FROM gone)
UNION ALL SELECT 'articles', count(*), CAST(sum(deal_id) AS BIGINT) FROM articles WHERE deal_id NOT IN (SELECT deal_id FROM gone) UNION ALL SELECT 'signals', count(*), CAST(sum(CASE WHEN d NOT IN (SELECT deal_id FROM gone) THEN d END) AS BIGINT) FROM l""")
def dml03_deleted_deals(v: Views) -> DataFrame:
    """What is left when deals go with their investors and articles, and signals lose their link."""
    tables = {"deals": v.deals, "investors": v.deal_investors, "articles": v.articles, "signals": v.signals}
    left = serving.without_deals(tables, v.deals.where("deal_id % 13 = 5").select("deal_id"), {"signals": "converted_deal_id"})
    counts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum("converted_deal_id" if n == "signals" else "deal_id").alias("checksum")) for n, t in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("""WITH s AS (SELECT company_id, name AS alias_name, 'rebrand' AS kind FROM companies WHERE company_id % 4 = 0), n AS (SELECT company_id, upper(name) AS alias_name, CASE company_id % 3 WHEN 0 THEN 'dba' WHEN 1 THEN 'typo' ELSE 'nickname' END AS kind FROM companies WHERE company_id % 4 <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(alias_name)) ORDER BY company_id) AS k FROM n WHERE kind <> 'nickname' AND lower(trim(alias_name)) NOT IN (SELECT lower(trim(alias_name)) FROM s)) SELECT company_id, alias_name, kind FROM s UNION ALL SELECT company_id, alias_name, kind FROM f WHERE k = 1""")
def dml08_aliases(v: Views) -> DataFrame:
    k = F.col("company_id")
    stored = v.companies.where("company_id % 4 = 0").select("company_id", F.col("name").alias("alias_name"), F.lit("rebrand").alias("kind"))
    new = v.companies.where("company_id % 4 != 0").select("company_id", F.upper("name").alias("alias_name"), F.when(k % 3 == 0, "dba").when(k % 3 == 1, "typo").otherwise("nickname").alias("kind"))
    return serving.with_aliases(stored, new)


@query("SELECT scan_id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 1 HOUR THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-09 23:00:00' THEN 'Marked as failed by cleanup (stuck >1 hour)' END AS error_message FROM scans")
def stm05_stale_scans(v: Views) -> DataFrame:
    return scans.failed_if_stale(v.scans, datetime.datetime(2024, 1, 10)).select("scan_id", "status", "error_message")


@query("""SELECT count(*) AS total_deals, count(*) FILTER (WHERE trim(coalesce(website, '')) <> '') AS with_website, count(*) FILTER (WHERE f) AS with_founders, count(*) FILTER (WHERE l) AS with_linkedin, count(*) FILTER (WHERE trim(coalesce(website, '')) <> '' AND l) AS with_both,
count(*) FILTER (WHERE trim(coalesce(website, '')) = '' AND NOT l) AS missing_both, count(*) FILTER (WHERE trim(coalesce(website, '')) = '') AS missing_website, count(*) FILTER (WHERE f) - count(*) FILTER (WHERE l) AS missing_linkedin,
round(100.0 * count(*) FILTER (WHERE trim(coalesce(website, '')) <> '') / count(*), 1) AS website_percentage, round(100.0 * count(*) FILTER (WHERE l) / count(*), 1) AS linkedin_percentage
FROM (SELECT website, coalesce(founders_json, '') <> '' AS f, coalesce(founders_json, '') LIKE '%"linkedin_url":"%' AS l FROM deals JOIN companies USING (company_id))""")
def agg04_full_coverage(v: Views) -> DataFrame:
    """Coverage with founders parsed from JSON; a malformed list has none."""
    founders = F.from_json("founders_json", "array<struct<name:string,linkedin_url:string>>")
    row = named_deals(v).select((F.trim(F.coalesce("website", F.lit(""))) != "").alias("site"), (F.coalesce("founders_json", F.lit("")) != "").alias("f"), F.coalesce(F.exists(founders, lambda x: F.coalesce(x["linkedin_url"], F.lit("")) != ""), F.lit(False)).alias("l"))
    n = row.agg(
        F.count("*").alias("total_deals"), F.count_if("site").alias("with_website"), F.count_if("f").alias("with_founders"), F.count_if("l").alias("with_linkedin"), F.count_if(F.col("site") & F.col("l")).alias("with_both"),
        F.count_if(~F.col("site") & ~F.col("l")).alias("missing_both"),
    )
    share = lambda c: F.when(F.col("total_deals") > 0, F.round(100.0 * F.col(c) / F.col("total_deals"), 1)).otherwise(0.0)
    return n.withColumns({
        "missing_website": F.col("total_deals") - F.col("with_website"), "missing_linkedin": F.col("with_founders") - F.col("with_linkedin"), "website_percentage": share("with_website"), "linkedin_percentage": share("with_linkedin"),
    })


_BANDS = {"conf_below_035": "score < 35", "conf_035_050": "score >= 35 AND score < 50", "conf_050_065": "score >= 50 AND score < 65", "conf_above_065": "score >= 65"}


@query(f"""WITH s AS (SELECT 'source ' || CAST(company_name AS VARCHAR) AS source, min(signal_id) % 5 = 0 AS failed, count(*) FILTER (WHERE score >= 90) AS articles, count(converted_deal_id) AS saved, {', '.join(f'count(*) FILTER (WHERE {w}) AS {c}' for c, w in _BANDS.items())}, count(*) FILTER (WHERE dismissed) AS rejected FROM signals GROUP BY 1)
SELECT count(*) AS sources, count(*) FILTER (WHERE NOT failed) AS successful, count(*) FILTER (WHERE failed) AS failed, CAST(sum(articles) AS BIGINT) AS articles, CAST(sum(saved) AS BIGINT) AS saved, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in _BANDS)}, CAST(sum(rejected) AS BIGINT) AS rejected,
coalesce(string_agg(CASE WHEN NOT failed AND articles = 0 AND source NOT IN ('source Company 1', 'source Company 2', 'source Company 3') THEN source END, ',' ORDER BY source), '') AS zero_result, round(100.0 * count(*) FILTER (WHERE NOT failed) / count(*), 1) AS health FROM s""")
def agg05_run_health(v: Views) -> DataFrame:
    """One run's sources: failures, bands, rejections, and those without results that should have some."""
    stats = v.signals.groupBy(F.concat(F.lit("source "), "company_name").alias("source")).agg(
        (F.min("signal_id") % 5 == 0).alias("failed"), F.count_if(F.col("score") >= 90).alias("articles"), F.count("converted_deal_id").alias("saved"), *[F.count_if(F.expr(w)).alias(c) for c, w in _BANDS.items()], F.count_if("dismissed").alias("rejected")
    )
    return scans.health(stats, ["source Company 1", "source Company 2", "source Company 3"])


@query("""WITH s AS (SELECT status, item_id, row_number() OVER (PARTITION BY status ORDER BY item_id) * 2 AS position FROM tracker WHERE item_id % 3 = 0), m AS (SELECT status, max(position) AS last FROM s GROUP BY status)
SELECT t.item_id, coalesce(m.last, -1) + row_number() OVER (PARTITION BY t.status ORDER BY t.item_id) AS position FROM tracker t LEFT JOIN m USING (status) WHERE t.item_id % 3 = 1""")
def agg10_next_positions(v: Views) -> DataFrame:
    from pyspark.sql import Window

    stored = v.tracker.where("item_id % 3 = 0").withColumn("position", F.row_number().over(Window.partitionBy("status").orderBy("item_id")) * 2)
    return serving.next_positions(stored, v.tracker.where("item_id % 3 = 1")).select("item_id", "position")


@query("SELECT seq FROM (SELECT id AS seq, id % 50 AS h, CASE WHEN id % 7 = 0 THEN 10 + id ELSE 10 END AS n FROM landed_rows) AS t WHERE NOT EXISTS (SELECT 1 FROM landed_rows o WHERE o.id < t.seq AND o.id % 50 = t.h)")
def pre12_first_contents(v: Views) -> DataFrame:
    """Texts of a run whose hash is new; of equal lengths none comes again."""
    rows = v.landed_rows.select(F.col("id").alias("seq"), (F.col("id") % 50).alias("content_hash"), F.lit(10).cast("long").alias("n_chars"))
    return serving.not_repeated(rows).select("seq")


@query("""WITH RECURSIVE r AS (SELECT id, id % 40 AS h, row_number() OVER (PARTITION BY id % 40 ORDER BY id) AS k, 10 + id * id % 97 AS n FROM landed_rows), f AS (SELECT h, k, id, n AS last, true AS kept FROM r WHERE k = 1
UNION ALL SELECT r.h, r.k, r.id, CASE WHEN r.n > 2 * f.last THEN r.n ELSE f.last END, r.n > 2 * f.last FROM f JOIN r ON r.h = f.h AND r.k = f.k + 1) SELECT id AS seq FROM f WHERE kept""")
def pre12_longer_contents(v: Views) -> DataFrame:
    """Texts of a run that are new or more than twice as long as what stayed of their hash."""
    rows = v.landed_rows.select(F.col("id").alias("seq"), (F.col("id") % 40).alias("content_hash"), (F.col("id") * F.col("id") % 97 + 10).alias("n_chars"))
    return serving.not_repeated(rows).select("seq")


@query("SELECT article_id FROM articles WHERE url IN (SELECT url FROM articles WHERE article_id % 9 = 0)")
def pre06_known_urls(v: Views) -> DataFrame:
    return v.articles.join(v.articles.where("article_id % 9 = 0").select("url"), "url", "left_semi").select("article_id")


@query(f"SELECT article_id FROM articles WHERE published_date > DATE '{AS_OF}' - INTERVAL 30 DAY")
def pre15_live_hashes(v: Views) -> DataFrame:
    """Entries of the content store that a purge leaves."""
    now = datetime.datetime.combine(AS_OF, datetime.time())
    return serving.live(v.articles.withColumn("stored_at", F.col("published_date").cast("timestamp")), now).select("article_id")


@query(f"""WITH s AS (SELECT company_id, {norm_sql('name')} AS slug FROM companies) SELECT company_id, slug || CASE WHEN n > 1 THEN '_' || CAST(n - 1 AS VARCHAR) ELSE '' END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY company_id) AS n FROM s)""")
def str04_unique_slugs(v: Views) -> DataFrame:
    rows = v.companies.select("company_id", names.normal_form(F.col("name")).alias("slug"))
    return serving.unique_slugs(rows, "slug", "company_id")


@query("SELECT count(*) AS n, count(DISTINCT url) AS urls FROM (SELECT url FROM articles UNION SELECT url FROM pages)")
def set05_all_urls(v: Views) -> DataFrame:
    every = v.articles.select("url").unionByName(v.table("pages").select("url")).distinct()
    return every.agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query("""WITH q AS (SELECT CAST(k AS VARCHAR) AS search, 'fund_' || CAST(k % 7 AS VARCHAR) AS fund FROM (SELECT DISTINCT id % 30 AS k FROM landed_rows)) SELECT r.id, q.fund FROM landed_rows r JOIN q ON CAST(r.id % 30 AS VARCHAR) = q.search""")
def join11_result_funds(v: Views) -> DataFrame:
    """Search results with the fund that their query was for."""
    searches = v.landed_rows.select((F.col("id") % 30).alias("k")).distinct().select(F.col("k").cast("string").alias("search"), F.concat(F.lit("fund_"), (F.col("k") % 7).cast("string")).alias("fund"))
    return v.landed_rows.select("id", (F.col("id") % 30).cast("string").alias("search")).join(searches, "search").select("id", "fund")


@query("SELECT company_id, f.url FROM (SELECT company_id, 'Founder ' || CAST(company_id % 60 AS VARCHAR) AS founder FROM companies) c LEFT JOIN (SELECT lower('FOUNDER ' || CAST(id % 60 AS VARCHAR)) AS k, min(url) AS url FROM landed_parts WHERE url IS NOT NULL AND id % 60 < 40 GROUP BY 1) f ON lower(c.founder) = f.k")
def join12_founder_links(v: Views) -> DataFrame:
    """Founders with the address found for their name, whatever its case."""
    found = v.landed_parts.where("url IS NOT NULL AND id % 60 < 40").groupBy(F.lower(F.concat(F.lit("FOUNDER "), (F.col("id") % 60).cast("string"))).alias("k")).agg(F.min("url").alias("url"))
    founders = v.companies.select("company_id", F.lower(F.concat(F.lit("Founder "), (F.col("company_id") % 60).cast("string"))).alias("k"))
    return founders.join(found, "k", "left").select("company_id", "url")


@query("SELECT icao, arg_max(altitude, seen_at) AS altitude FROM aircraft WHERE event_id % 2 = 0 GROUP BY icao")
def stm02_served_positions(v: Views) -> DataFrame:
    """A failed poll serves what the last good one had."""
    latest = lambda rest: v.aircraft.where(F.col("event_id") % 2 == rest).groupBy("icao").agg(F.max_by("altitude", "seen_at").alias("altitude"))
    return serving.served_positions(latest(1), latest(0), failed=True)


@query("SELECT user_id AS icao, arg_max(value, ts) AS altitude FROM events WHERE user_id % 2 = 1 GROUP BY 1")
def apx31_one_kind_of_aircraft(v: Views) -> DataFrame:
    return v.aircraft.where("icao % 2 = 1").groupBy("icao").agg(F.max_by("altitude", "seen_at").alias("altitude"))


@query("""SELECT deal_id, CASE WHEN w THEN 'website' WHEN f THEN 'founders' ELSE 'both' END AS missing FROM (SELECT deal_id, coalesce(website, '') = '' AS w, coalesce(founders_json, '') IN ('', '[]') AS f, created_date FROM deals JOIN companies USING (company_id)) WHERE w OR f ORDER BY created_date DESC, deal_id LIMIT 50""")
def enr07_link_worklist(v: Views) -> DataFrame:
    """The newest deals without a website or without founders."""
    w, f = F.coalesce("website", F.lit("")) == "", F.coalesce("founders_json", F.lit("")).isin("", "[]")
    rows = named_deals(v).where(w | f).orderBy(F.desc("created_date"), "deal_id").limit(50)
    return rows.select("deal_id", F.when(w, "website").when(f, "founders").otherwise("both").alias("missing"))


@query("""SELECT a.company_id AS a_id, min(b.company_id) AS b_id FROM companies a JOIN (SELECT company_id, lower(trim('Old ' || name)) AS k FROM companies) b ON lower(trim(CASE WHEN a.company_id % 2 = 0 THEN 'old ' || a.name ELSE a.name END)) = b.k GROUP BY 1""")
def str03_names_by_alias(v: Views) -> DataFrame:
    """Companies that a name means through an alias."""
    from ledgerloom.operators.registry import by_alias

    aliases = v.companies.select(F.concat(F.lit("Old "), "name").alias("alias_name"), "company_id")
    named = v.companies.select(F.col("company_id").alias("a_id"), F.when(F.col("company_id") % 2 == 0, F.concat(F.lit("old "), "name")).otherwise(F.col("name")).alias("name"))
    return by_alias(named, aliases).where("company_id IS NOT NULL").select("a_id", F.col("company_id").alias("b_id"))
