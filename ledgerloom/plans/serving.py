"""Serving queries: filtered and paged lists, reports, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, pages
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import AS_OF, Views

_DEAL_ORDER = "ORDER BY announced_date DESC NULLS LAST, created_date DESC, deal_id"


def tracked_leads(v: Views) -> DataFrame:
    """Deals that a tracked fund leads."""
    return v.deal_investors.where("is_lead AND is_tracked_fund").select("deal_id").distinct()


def page(df: DataFrame, first: int, rows: int) -> DataFrame:
    """A page of deals, newest first."""
    return df.orderBy(F.desc_nulls_last("announced_date"), F.desc("created_date"), "deal_id").offset(first).limit(rows)


@query(f"""SELECT d.deal_id, c.name, d.round_type, d.amount_usd, d.announced_date FROM deals d JOIN companies c USING (company_id)
WHERE round_type = 'series_a' AND is_enterprise_ai AND c.name ILIKE '%labs%' {_DEAL_ORDER.replace('deal_id', 'd.deal_id')} LIMIT 50 OFFSET 10""")
def qry01_deals_page(v: Views) -> DataFrame:
    rows = v.deals.where("round_type = 'series_a' AND is_enterprise_ai").join(v.companies, "company_id").where(F.col("name").ilike("%labs%"))
    return page(rows, 10, 50).select("deal_id", "name", "round_type", "amount_usd", "announced_date")


@query(f"""SELECT deal_id, round_type, announced_date FROM deals WHERE deal_id IN (SELECT deal_id FROM deal_investors WHERE is_lead AND is_tracked_fund) {_DEAL_ORDER} LIMIT 100""")
def qry01_led_deals(v: Views) -> DataFrame:
    return page(v.deals.join(tracked_leads(v), "deal_id", "left_semi"), 0, 100).select("deal_id", "round_type", "announced_date")


@query("""SELECT count(*) AS n, count(announced_date) AS dated FROM deals WHERE deal_id NOT IN (SELECT deal_id FROM deal_investors WHERE is_lead AND is_tracked_fund)""")
def qry01_other_deals_count(v: Views) -> DataFrame:
    return v.deals.join(tracked_leads(v), "deal_id", "left_anti").agg(F.count("*").alias("n"), F.count("announced_date").alias("dated"))


@query(f"""SELECT d.deal_id, d.round_type, f.slug FROM deals d JOIN deal_investors i USING (deal_id) JOIN funds f USING (fund_id) WHERE d.is_lead_confirmed AND f.slug = 'fund_3' {_DEAL_ORDER.replace('deal_id', 'd.deal_id')}, i.position LIMIT 200""")
def qry02_confirmed_deals(v: Views) -> DataFrame:
    rows = v.deals.where("is_lead_confirmed").join(v.deal_investors, "deal_id").join(v.funds.where("slug = 'fund_3'"), "fund_id")
    rows = rows.orderBy(F.desc_nulls_last("announced_date"), F.desc("created_date"), "deal_id", "position").limit(200)
    return rows.select("deal_id", "round_type", "slug")


@query("""WITH leads AS (SELECT deal_id, arg_min(fund_id, position * 1000000 + fund_id) AS lead_fund FROM deal_investors WHERE is_lead AND is_tracked_fund GROUP BY deal_id)
SELECT d.deal_id AS "ID", c.name AS "Company", d.round_type AS "Round", coalesce(CAST(d.amount_usd AS VARCHAR), 'Undisclosed') AS "Amount", coalesce(strftime(d.announced_date, '%Y-%m-%d'), '') AS "Date",
CASE WHEN l.lead_fund IS NULL THEN '' ELSE f.slug END AS "Lead" FROM deals d JOIN companies c USING (company_id) LEFT JOIN leads l USING (deal_id) LEFT JOIN funds f ON f.fund_id = l.lead_fund WHERE d.is_ai_deal""")
def qry03_export(v: Views) -> DataFrame:
    leads = v.deal_investors.where("is_lead AND is_tracked_fund").groupBy("deal_id").agg(F.min_by("fund_id", F.struct("position", "fund_id")).alias("fund_id"))
    rows = v.deals.where("is_ai_deal").join(v.companies, "company_id").join(leads, "deal_id", "left").join(v.funds, "fund_id", "left")
    return rows.select(
        F.col("deal_id").alias("ID"), F.col("name").alias("Company"), F.col("round_type").alias("Round"), F.coalesce(F.col("amount_usd").cast("string"), F.lit("Undisclosed")).alias("Amount"),
        F.coalesce(F.date_format("announced_date", "yyyy-MM-dd"), F.lit("")).alias("Date"), F.coalesce("slug", F.lit("")).alias("Lead"),
    )


@query("""SELECT deal_id, array_to_string(list(DISTINCT CASE WHEN is_lead THEN 'lead' ELSE 'non_lead' END ORDER BY CASE WHEN is_lead THEN 'lead' ELSE 'non_lead' END), ',') AS roles, count(*) AS investors
FROM deal_investors WHERE is_tracked_fund GROUP BY deal_id
UNION ALL SELECT deal_id, 'stealth', 0 FROM deals WHERE deal_id NOT IN (SELECT deal_id FROM deal_investors WHERE is_tracked_fund)""")
def prj14_deal_roles(v: Views) -> DataFrame:
    role = F.when(F.col("is_lead"), "lead").otherwise("non_lead")
    roles = v.deal_investors.where("is_tracked_fund").groupBy("deal_id").agg(F.array_join(F.array_sort(F.collect_set(role)), ",").alias("roles"), F.count("*").alias("investors"))
    return v.deals.select("deal_id").join(roles, "deal_id", "left").select("deal_id", F.coalesce("roles", F.lit("stealth")).alias("roles"), F.coalesce("investors", F.lit(0)).alias("investors"))


@query("SELECT scan_id, started_at, status FROM scans WHERE status = 'success' ORDER BY started_at DESC, scan_id LIMIT 20 OFFSET 5")
def qry04_scans_page(v: Views) -> DataFrame:
    return v.scans.where("status = 'success'").orderBy(F.desc("started_at"), "scan_id").offset(5).limit(20).select("scan_id", "started_at", "status")


@query("""WITH lead AS (SELECT deal_id, arg_min(fund_id, position * 1000000 + fund_id) AS lead_fund FROM deal_investors WHERE is_lead GROUP BY deal_id),
art AS (SELECT deal_id, min(article_id) AS article_id FROM articles GROUP BY deal_id)
SELECT d.deal_id, c.name, l.lead_fund, a.article_id FROM deals d JOIN companies c USING (company_id) LEFT JOIN lead l USING (deal_id) LEFT JOIN art a USING (deal_id) WHERE d.scan_job_id = 7""")
def qry05_scan_detail(v: Views) -> DataFrame:
    lead = v.deal_investors.where("is_lead").groupBy("deal_id").agg(F.min_by("fund_id", F.struct("position", "fund_id")).alias("lead_fund"))
    first = v.articles.groupBy("deal_id").agg(F.min("article_id").alias("article_id"))
    rows = v.deals.where("scan_job_id = 7").join(v.companies, "company_id").join(lead, "deal_id", "left").join(first, "deal_id", "left")
    return rows.select("deal_id", "name", "lead_fund", "article_id")


@query("SELECT signal_id, company_name, score, spotted_at FROM signals WHERE source = 'click' AND score >= 60 AND NOT dismissed ORDER BY score DESC, spotted_at DESC, signal_id LIMIT 50")
def qry06_signals(v: Views) -> DataFrame:
    rows = v.signals.where("source = 'click' AND score >= 60 AND NOT dismissed").orderBy(F.desc("score"), F.desc("spotted_at"), "signal_id").limit(50)
    return rows.select("signal_id", "company_name", "score", "spotted_at")


@query("SELECT item_id, status, company_name, row_number() OVER (PARTITION BY status ORDER BY sort_key, item_id) - 1 AS position FROM tracker WHERE status IN ('watching', 'contacted')")
def qry09_tracker_items(v: Views) -> DataFrame:
    position = F.row_number().over(Window.partitionBy("status").orderBy("sort_key", "item_id")) - 1
    return v.tracker.where(F.col("status").isin("watching", "contacted")).select("item_id", "status", "company_name", position.cast("long").alias("position"))


@query("SELECT scan_id, deals_saved FROM (SELECT * FROM scans WHERE status = 'success' ORDER BY started_at DESC, scan_id LIMIT 5) WHERE deals_saved > 0 ORDER BY started_at DESC, scan_id LIMIT 1")
def qry10_latest_scan(v: Views) -> DataFrame:
    newest = v.scans.where("status = 'success'").orderBy(F.desc("started_at"), "scan_id").limit(5)
    return newest.where("deals_saved > 0").orderBy(F.desc("started_at"), "scan_id").limit(1).select("scan_id", "deals_saved")


@query("SELECT event_id, altitude FROM aircraft WHERE lat BETWEEN 8 AND 12 AND lon BETWEEN -62 AND 62 ORDER BY on_ground, altitude DESC, event_id LIMIT 250")
def qry11_viewport(v: Views) -> DataFrame:
    return v.aircraft.where("lat BETWEEN 8 AND 12 AND lon BETWEEN -62 AND 62").orderBy("on_ground", F.desc("altitude"), "event_id").limit(250).select("event_id", "altitude")


_COST = "(input_tokens * 0.8 + output_tokens * 4.0 + cache_read_tokens * 0.08 + cache_write_tokens * 1.0) / 1000000"


@query(f"""SELECT source_name, day, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens, round(sum({_COST}), 3) AS cost FROM usage GROUP BY GROUPING SETS ((source_name), (day), ())""")
def agg01_token_usage(v: Views) -> DataFrame:
    cost = (F.col("input_tokens") * 0.8 + F.col("output_tokens") * 4.0 + F.col("cache_read_tokens") * 0.08 + F.col("cache_write_tokens") * 1.0) / 1_000_000
    rows = v.usage.withColumn("cost", cost)
    return rows.groupingSets([["source_name"], ["day"], []], "source_name", "day").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.round(F.sum("cost"), 3).alias("cost"),
    )


@query(f"SELECT source_name, round(sum({_COST}), 3) AS cost FROM usage GROUP BY source_name")
def cst01_token_cost(v: Views) -> DataFrame:
    cost = amounts.token_cost(*(F.col(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")))
    return v.usage.groupBy("source_name").agg(F.round(F.sum(cost), 3).alias("cost"))


@query("SELECT scan_job_id, count(*) AS deals, count(*) FILTER (WHERE is_enterprise_ai) AS enterprise, count(*) FILTER (WHERE is_lead_confirmed) AS led FROM deals GROUP BY scan_job_id")
def agg02_scan_counts(v: Views) -> DataFrame:
    return v.deals.groupBy("scan_job_id").agg(F.count("*").alias("deals"), F.count_if("is_enterprise_ai").alias("enterprise"), F.count_if("is_lead_confirmed").alias("led"))


@query("SELECT source, count(*) AS total, round(coalesce(avg(score), 0), 1) AS avg_score, count(converted_deal_id) AS converted FROM signals WHERE NOT dismissed GROUP BY source")
def agg03_signal_stats(v: Views) -> DataFrame:
    return v.signals.where("NOT dismissed").groupBy("source").agg(F.count("*").alias("total"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 1).alias("avg_score"), F.count("converted_deal_id").alias("converted"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(website, '') <> '') AS with_website, count(*) FILTER (WHERE linkedin_url IS NOT NULL) AS with_linkedin,
count(*) FILTER (WHERE coalesce(website, '') <> '' AND linkedin_url IS NOT NULL) AS with_both, count(*) FILTER (WHERE coalesce(founders_json, '') LIKE '%linkedin.com%') AS with_founder,
round(100.0 * count(*) FILTER (WHERE coalesce(website, '') <> '') / count(*), 1) AS website_pct FROM deals JOIN companies USING (company_id)""")
def agg04_coverage(v: Views) -> DataFrame:
    site, link = F.coalesce("website", F.lit("")) != "", F.col("linkedin_url").isNotNull()
    founder = F.coalesce("founders_json", F.lit("")).contains("linkedin.com")
    counts = v.deals.join(v.companies, "company_id").agg(F.count("*").alias("total"), F.count_if(site).alias("with_website"), F.count_if(link).alias("with_linkedin"), F.count_if(site & link).alias("with_both"), F.count_if(founder).alias("with_founder"))
    return counts.withColumn("website_pct", F.round(100.0 * F.col("with_website") / F.col("total"), 1))


@query("""SELECT trigger_name, count(*) AS runs, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(deals_saved) AS BIGINT) AS saved,
round(100.0 * count(*) FILTER (WHERE status <> 'failed') / count(*), 1) AS health FROM scans GROUP BY trigger_name ORDER BY saved DESC, trigger_name""")
def agg05_source_health(v: Views) -> DataFrame:
    stats = v.scans.groupBy("trigger_name").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("deals_saved").alias("saved"))
    return stats.withColumn("health", F.round(100.0 * (F.col("runs") - F.col("failed")) / F.col("runs"), 1)).orderBy(F.desc("saved"), "trigger_name")


@query("SELECT s.status, count(t.item_id) AS items FROM (VALUES ('watching'), ('contacted'), ('passed'), ('closed')) AS s(status) LEFT JOIN tracker t USING (status) GROUP BY s.status")
def agg06_tracker_counts(v: Views) -> DataFrame:
    columns = v.spark.createDataFrame([(s,) for s in ("watching", "contacted", "passed", "closed")], "status string")
    return columns.join(v.tracker.groupBy("status").agg(F.count("*").alias("items")), "status", "left").select("status", F.coalesce("items", F.lit(0)).alias("items"))


@query("SELECT category, count(*) FILTER (WHERE NOT on_ground) AS airborne, count(*) FILTER (WHERE on_ground) AS grounded FROM aircraft GROUP BY category")
def agg07_aircraft_stats(v: Views) -> DataFrame:
    return v.aircraft.groupBy("category").agg(F.count_if(~F.col("on_ground")).alias("airborne"), F.count_if("on_ground").alias("grounded"))


@query(f"WITH p AS (SELECT * FROM deals {_DEAL_ORDER} LIMIT 100) SELECT CAST(round(100.0 * count(*) FILTER (WHERE is_enterprise_ai) / count(*)) AS BIGINT) AS enterprise_pct, CAST(round(100.0 * count(*) FILTER (WHERE is_lead_confirmed) / count(*)) AS BIGINT) AS verified_pct FROM p")
def agg08_page_ratios(v: Views) -> DataFrame:
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*")).cast("long")
    return page(v.deals, 0, 100).agg(share("is_enterprise_ai").alias("enterprise_pct"), share("is_lead_confirmed").alias("verified_pct"))


@query("""SELECT c.company_id, d.deal_id, i.fund_id FROM deals d JOIN companies c USING (company_id) LEFT JOIN (SELECT deal_id, fund_id FROM deal_investors WHERE is_lead) i USING (deal_id) WHERE coalesce(c.website, '') = ''""")
def join05_missing_website(v: Views) -> DataFrame:
    leads = v.deal_investors.where("is_lead").select("deal_id", "fund_id")
    rows = v.deals.join(v.companies.where("coalesce(website, '') = ''"), "company_id").join(leads, "deal_id", "left")
    return rows.select("company_id", "deal_id", "fund_id")


@query("SELECT deal_id, count(*) AS investors, CAST(sum(position) AS BIGINT) AS positions, min(fund_id) AS first_fund FROM deal_investors GROUP BY deal_id")
def join07_nested_investors(v: Views) -> DataFrame:
    nested = v.deal_investors.groupBy("deal_id").agg(F.collect_list(F.struct("position", "fund_id", "is_lead")).alias("investors"))
    total = F.aggregate("investors", F.lit(0).cast("long"), lambda a, x: a + x["position"])
    return nested.select("deal_id", F.size("investors").cast("long").alias("investors"), total.alias("positions"), F.array_min(F.transform("investors", lambda x: x["fund_id"])).alias("first_fund"))


@query("""SELECT d.deal_id, least(d.announced_date, a.first_seen) AS announced_date FROM deals d JOIN (SELECT deal_id, min(published_date) AS first_seen FROM articles GROUP BY deal_id) a USING (deal_id)
WHERE a.first_seen IS NOT NULL AND (d.announced_date IS NULL OR a.first_seen < d.announced_date)""")
def enr13_crossref_dates(v: Views) -> DataFrame:
    seen = v.articles.groupBy("deal_id").agg(F.min("published_date").alias("first_seen")).where("first_seen IS NOT NULL")
    rows = v.deals.join(seen, "deal_id").where("announced_date IS NULL OR first_seen < announced_date")
    return rows.select("deal_id", F.least("announced_date", "first_seen").alias("announced_date"))


@query("""SELECT d.deal_id, a.published_date AS announced_date FROM deals d JOIN (SELECT deal_id, arg_min(published_date, article_id) AS published_date FROM articles WHERE published_date IS NOT NULL GROUP BY deal_id) a USING (deal_id) WHERE d.announced_date IS NULL""")
def enr12_backfill_dates(v: Views) -> DataFrame:
    first = v.articles.where("published_date IS NOT NULL").groupBy("deal_id").agg(F.min_by("published_date", "article_id").alias("published_date"))
    return v.deals.where("announced_date IS NULL").join(first, "deal_id").select("deal_id", F.col("published_date").alias("announced_date"))


@query("SELECT deal_id, created_date FROM deals WHERE announced_date IS NULL ORDER BY created_date DESC, deal_id LIMIT 100")
def enr06_date_worklist(v: Views) -> DataFrame:
    return v.deals.where("announced_date IS NULL").orderBy(F.desc("created_date"), "deal_id").limit(100).select("deal_id", "created_date")


@query(f"SELECT count(*) AS kept FROM deals WHERE coalesce(announced_date, created_date) >= DATE '{AS_OF}' - INTERVAL 365 DAY")
def dml02_cleanup(v: Views) -> DataFrame:
    old = F.coalesce("announced_date", "created_date") < F.date_sub(F.lit(AS_OF), 365)
    gone = v.deals.where(old).select("deal_id")
    return v.deals.join(gone, "deal_id", "left_anti").agg(F.count("*").alias("kept"))


@query("""SELECT item_id, status, row_number() OVER (PARTITION BY status ORDER BY moved, sort_key, item_id) - 1 AS position
FROM (SELECT item_id, sort_key, CASE WHEN item_id % 70 = 0 THEN 'passed' ELSE status END AS status, item_id % 70 = 0 AS moved FROM tracker WHERE item_id % 50 <> 0)""")
def dml04_dense_positions(v: Views) -> DataFrame:
    moved = F.col("item_id") % 70 == 0
    kept = v.tracker.where("item_id % 50 <> 0").select("item_id", "sort_key", F.when(moved, "passed").otherwise(F.col("status")).alias("status"), moved.alias("moved"))
    return kept.select("item_id", "status", (F.row_number().over(Window.partitionBy("status").orderBy("moved", "sort_key", "item_id")) - 1).cast("long").alias("position"))


@query("SELECT lower(trim(company_name)) AS name_key, min(item_id) AS item_id FROM tracker WHERE trim(company_name) <> '' GROUP BY 1")
def dml07_bulk_create(v: Views) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("name_key").orderBy("item_id"))
    rows = v.tracker.where(F.trim("company_name") != "").withColumn("name_key", F.lower(F.trim("company_name"))).withColumn("rn", first)
    return rows.where("rn = 1").select("name_key", "item_id")


@query("SELECT signal_id, CASE WHEN score < 20 THEN true ELSE dismissed END AS dismissed, CASE WHEN converted_deal_id % 16 = 0 THEN NULL ELSE converted_deal_id END AS converted_deal_id FROM signals")
def dml06_dismiss_and_unlink(v: Views) -> DataFrame:
    return v.signals.select("signal_id", F.when(F.col("score") < 20, True).otherwise(F.col("dismissed")).alias("dismissed"), F.when(F.col("converted_deal_id") % 16 == 0, None).otherwise(F.col("converted_deal_id")).alias("converted_deal_id"))


@query("SELECT company_name, source, CAST(greatest(0, least(100, max(score))) AS BIGINT) AS score, max(signal_id) AS latest, arg_max(spotted_at, signal_id) AS spotted_at FROM signals GROUP BY company_name, source")
def snk03_upsert_signals(v: Views) -> DataFrame:
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.max("score"))).cast("long")
    return v.signals.groupBy("company_name", "source").agg(score.alias("score"), F.max("signal_id").alias("latest"), F.max_by("spotted_at", "signal_id").alias("spotted_at"))


@query("""SELECT lower(name) AS name_key, min(company_id) AS company_id, arg_min(website, company_id) FILTER (WHERE coalesce(website, '') <> '') AS website, arg_min(linkedin_url, company_id) FILTER (WHERE linkedin_url IS NOT NULL) AS linkedin_url FROM companies GROUP BY 1""")
def snk02_upsert_companies(v: Views) -> DataFrame:
    known = F.when(F.coalesce("website", F.lit("")) != "", F.col("company_id"))
    linked = F.when(F.col("linkedin_url").isNotNull(), F.col("company_id"))
    return v.companies.groupBy(F.lower("name").alias("name_key")).agg(F.min("company_id").alias("company_id"), F.min_by("website", known).alias("website"), F.min_by("linkedin_url", linked).alias("linkedin_url"))


@query("""WITH cur AS (SELECT DISTINCT fund_slug, lower(name) AS name FROM snapshots WHERE side = 'cur'), prev AS (SELECT DISTINCT fund_slug, lower(name) AS name FROM snapshots WHERE side = 'prev')
SELECT fund_slug, name, 'new' AS change FROM (SELECT * FROM cur EXCEPT SELECT * FROM prev) UNION ALL SELECT fund_slug, name, 'removed' FROM (SELECT * FROM prev EXCEPT SELECT * FROM cur)""")
def set01_snapshot_changes(v: Views) -> DataFrame:
    named = v.snapshots.select("fund_slug", F.lower("name").alias("name"), "side").distinct().groupBy("fund_slug", "name").agg(F.max(F.col("side") == "cur").alias("cur"), F.max(F.col("side") == "prev").alias("prev"))
    return named.where("cur != prev").select("fund_slug", "name", F.when(F.col("cur"), "new").otherwise("removed").alias("change"))


@query("""WITH n AS (SELECT fund_slug, replace(lower(name), 'small', 'stripe') AS name, bool_or(side = 'cur') AS cur, bool_or(side = 'prev') AS prev FROM snapshots GROUP BY 1, 2),
g AS (SELECT fund_slug, count(*) FILTER (WHERE cur AND NOT prev) AS added, bool_or(prev) AS known FROM n GROUP BY 1)
SELECT n.fund_slug, n.name FROM n JOIN g USING (fund_slug) WHERE n.cur AND NOT n.prev AND g.known AND g.added <= 10 AND NOT starts_with(n.name, 'stripe')""")
def set03_guarded_additions(v: Views) -> DataFrame:
    named = v.snapshots.groupBy("fund_slug", F.replace(F.lower("name"), F.lit("small"), F.lit("stripe")).alias("name")).agg(F.max(F.col("side") == "cur").alias("cur"), F.max(F.col("side") == "prev").alias("prev"))
    guard = named.groupBy("fund_slug").agg(F.count_if(F.col("cur") & ~F.col("prev")).alias("added"), F.max("prev").alias("known")).where("known AND added <= 10")
    return named.where("cur AND NOT prev").join(guard, "fund_slug", "left_semi").where(~pages.well_known(F.col("name"))).select("fund_slug", "name")


@query("SELECT day, avg(CASE WHEN event_id % 9 = 0 THEN 1.0 ELSE 0.0 END) > 0.1 AS alarm, count(*) AS n FROM usage GROUP BY day")
def agg12_failure_alarm(v: Views) -> DataFrame:
    failed = F.when(F.col("event_id") % 9 == 0, 1.0).otherwise(0.0)
    return v.usage.groupBy("day").agg((F.avg(failed) > 0.1).alias("alarm"), F.count("*").alias("n"))


@query("""SELECT event_id, CASE WHEN on_ground THEN 'ground' WHEN m > 10000 THEN 'over 10000' WHEN m > 5000 THEN 'over 5000' WHEN m > 1000 THEN 'over 1000' ELSE 'low' END AS band, CASE WHEN m = 0 THEN 'Ground' ELSE format('{:,}', CAST(round(m * 3.28084) AS BIGINT)) || ' ft' END AS height,
CASE WHEN event_id % 50 = 0 THEN '-' ELSE CAST(CAST(round(event_id % 50 * 1.94384) AS BIGINT) AS VARCHAR) || ' kts' END AS speed FROM (SELECT event_id, on_ground, floor(altitude) * 100 AS m FROM aircraft)""")
def geo02_altitude_bands(v: Views) -> DataFrame:
    """Bands of altitude, feet and knots as a map shows them."""
    metres, speed = F.floor("altitude") * 100, F.col("event_id") % 50
    band = F.when(F.col("on_ground"), "ground").when(metres > 10_000, "over 10000").when(metres > 5_000, "over 5000").when(metres > 1_000, "over 1000").otherwise("low")
    height = F.when(metres == 0, "Ground").otherwise(F.concat(F.format_number(F.round(metres * 3.28084), 0), F.lit(" ft")))
    knots = F.when(speed == 0, "-").otherwise(F.concat(F.round(speed * 1.94384).cast("long").cast("string"), F.lit(" kts")))
    return v.aircraft.select("event_id", band.alias("band"), height.alias("height"), knots.alias("speed"))


@query("SELECT event_id, source_name FROM usage WHERE source_name = 'error' ORDER BY day DESC, event_id DESC LIMIT 30")
def qry08_feedback(v: Views) -> DataFrame:
    return v.usage.where("source_name = 'error'").orderBy(F.desc("day"), F.desc("event_id")).limit(30).select("event_id", "source_name")


@query("SELECT f.slug, count(DISTINCT d.deal_id) AS deals, count(DISTINCT CASE WHEN i.is_lead THEN d.deal_id END) AS led, CAST(sum(CASE WHEN i.is_lead THEN d.amount_usd END) AS BIGINT) AS led_usd FROM deal_investors i JOIN deals d USING (deal_id) JOIN funds f USING (fund_id) WHERE i.is_tracked_fund GROUP BY f.slug")
def apx29_fund_metrics(v: Views) -> DataFrame:
    rows = v.deal_investors.where("is_tracked_fund").join(v.deals, "deal_id").join(v.funds, "fund_id")
    led = F.when(F.col("is_lead"), F.col("deal_id"))
    return rows.groupBy("slug").agg(F.count_distinct("deal_id").alias("deals"), F.count_distinct(led).alias("led"), F.sum(F.when(F.col("is_lead"), F.col("amount_usd"))).alias("led_usd"))


@query("SELECT item_id, CASE WHEN status = 'passed' THEN 'watching' ELSE status END AS status FROM tracker")
def dml05_retired_column(v: Views) -> DataFrame:
    """Items of a retired column move to another; positions stay as they are."""
    return v.tracker.select("item_id", F.when(F.col("status") == "passed", "watching").otherwise(F.col("status")).alias("status"))


@query("SELECT company_id, coalesce(CASE WHEN company_id % 3 = 0 THEN 'https://new.example' END, website) AS website, coalesce(CASE WHEN company_id % 6 = 0 THEN 'https://linkedin.com/company/new' END, linkedin_url) AS linkedin_url FROM companies")
def dml01_partial_update(v: Views) -> DataFrame:
    """Only the given fields change."""
    changes = v.companies.where("company_id % 3 = 0").select("company_id", F.lit("https://new.example").alias("w"), F.when(F.col("company_id") % 6 == 0, "https://linkedin.com/company/new").alias("l"))
    return v.companies.join(changes, "company_id", "left").select("company_id", F.coalesce("w", "website").alias("website"), F.coalesce("l", "linkedin_url").alias("linkedin_url"))
