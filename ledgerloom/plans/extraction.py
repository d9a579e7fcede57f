"""Extraction: validation of deals, fund matching, merging of sources, streams and readers over the test tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fixed, funds
from ledgerloom.operators import likeness, merge, validate
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import AS_OF, Views
from ledgerloom.sources import exports
from ledgerloom.streaming import flows


def extractions(v: Views) -> DataFrame:
    """Deals as an extractor might return them, from the articles."""
    k = F.col("article_id")
    return v.articles.select(
        "article_id", "text", (k % 3 == 0).alias("external"), F.element_at(F.array(*map(F.lit, ["Acme", "Gamma Pay", "How to Build a Startup", "Zeta Data", "Token Works"])), (k % 5 + 1).cast("int")).alias("startup_name"),
        F.when(k % 4 == 0, "AI platform for enterprise search").when(k % 4 == 1, "consumer mobile app").otherwise("b2b software").alias("startup_description"),
        F.element_at(F.array(*map(F.lit, ["seed", "series_a", "bridge", "growth"])), (k % 4 + 1).cast("int")).alias("round_label"), (k * 1_000_000 % 90_000_000).alias("amount_usd"),
        F.element_at(F.array(*map(F.lit, ["vertical_saas", "crypto", "fintech", "hardware", "consumer_ai"])), (k % 5 + 1).cast("int")).alias("category"), (k % 2 == 0).alias("is_ai"), (k % 4 == 0).alias("is_enterprise"),
        F.lit(True).alias("announcement"), F.when(k % 50 == 0, float("nan")).otherwise((k % 12) / 10.0).alias("confidence"), F.when(k % 2 == 0, "led by Foo").alias("snippet"),
        F.array(F.lit("Foo"), F.lit("Bar Capital")).alias("lead_investors"), F.array(F.lit("Baz")).alias("participants"), F.array(F.lit("Jane Doe"), F.lit("John Roe")).alias("founders"), F.when(k % 3 == 0, "accel").alias("tracked_fund"),
    )


@query()
def val03_judged_articles(v: Views) -> DataFrame:
    """Deals of every article through all validation steps; val01 holds the steps' results, case by case."""
    out = validate.judge(extractions(v), funding_only=False)
    return out.select("article_id", "round_label", F.round("confidence", 6).alias("confidence"), "category", "is_ai", "is_enterprise", "announcement", "lead_status", "amount_review", "band", "verdict")


_INVESTORS = ["Felicis Ventures", "Andreessen Horowitz", "Benchmark International", "GV", "Accel and Sequoia Capital", "Thrive Market", "a16z crypto", "First Round", "Someone Else", "Sequoia India"]
_MATCHED = ["felicis", "a16z", None, "gv", "accel", None, None, "first_round", None, None]


@query("SELECT fund_id, CASE fund_id % 10 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_MATCHED) if m) + " END AS matched FROM funds")
def cls13_matched_funds(v: Views) -> DataFrame:
    investor = F.element_at(F.array(*map(F.lit, _INVESTORS)), (F.col("fund_id") % 10 + 1).cast("int"))
    return v.funds.select("fund_id", funds.matched_fund(investor).alias("matched"))


@query(r"""SELECT article_id, regexp_matches(lower(text), '(^|[^\pL\pN_])(led[[:space:]]+by|led[[:space:]]+the|leading|co-led|co-leads?|headed[[:space:]]+by|lead[[:space:]]+investor|spearheaded)($|[^\pL\pN_])|(^|[^\pL\pN_])leads?[[:space:]]+') AS led FROM articles""")
def cls07_lead_language(v: Views) -> DataFrame:
    return v.articles.select("article_id", funds.lead_language(F.col("text")).alias("led"))


@query("""SELECT deal_id, CASE WHEN n IS NULL THEN o WHEN o IS NULL THEN n WHEN abs(n - o) <= 1 THEN o WHEN ns > os THEN n WHEN (day(o) = 1 AND month(o) IN (1, 4, 7, 10)) AND NOT (day(n) = 1 AND month(n) IN (1, 4, 7, 10)) THEN n WHEN n < o AND ns >= os - 0.1 THEN n ELSE o END AS date
FROM (SELECT deal_id, announced_date AS o, CASE WHEN deal_id % 13 = 0 THEN NULL ELSE created_date + CAST(deal_id % 9 - 4 AS INT) END AS n, (deal_id % 4) / 4.0 AS os, (deal_id % 5) / 5.0 AS ns FROM deals)""")
def res02_merged_dates(v: Views) -> DataFrame:
    k = F.col("deal_id")
    new = F.when(k % 13 != 0, F.date_add("created_date", (k % 9 - 4).cast("int")))
    return v.deals.select("deal_id", merge.merged_date(F.col("announced_date"), (k % 4) / 4.0, new, (k % 5) / 5.0)["date"].alias("date"))


@query(f"""SELECT deal_id, CASE WHEN announced_date IS NOT NULL THEN CASE WHEN deal_id % 3 = 0 THEN 0.60 WHEN deal_id % 40 > 14 THEN 0.55 ELSE 0.70 END WHEN deal_id % 3 = 0 THEN 0.50 WHEN created_date <= DATE '{AS_OF}' THEN 0.40 ELSE 0.50 END AS sure FROM deals""")
def res02_date_confidence(v: Views) -> DataFrame:
    k = F.col("deal_id")
    article = F.when(k % 3 != 0, F.date_add(F.coalesce("announced_date", "created_date"), F.when(F.col("announced_date").isNotNull(), (k % 40).cast("int")).otherwise(0)))
    return v.deals.select("deal_id", merge.date_confidence(article, F.col("announced_date"), AS_OF).cast("double").alias("sure"))


@query("""WITH RECURSIVE r AS (SELECT deal_id, published_date AS d, article_id % 7 / 10.0::DOUBLE AS c, row_number() OVER (PARTITION BY deal_id ORDER BY article_id) AS k FROM articles WHERE published_date IS NOT NULL),
f AS (SELECT deal_id, k, [d] AS days, [c] AS sums, [1] AS ns FROM r WHERE k = 1 UNION ALL SELECT r.deal_id, r.k, CASE WHEN p IS NULL THEN list_append(days, r.d) ELSE days END, CASE WHEN p IS NULL THEN list_append(sums, r.c) ELSE list_transform(sums, lambda s, i: CASE WHEN i = p THEN s + r.c ELSE s END) END,
CASE WHEN p IS NULL THEN list_append(ns, 1) ELSE list_transform(ns, lambda n, i: CASE WHEN i = p THEN n + 1 ELSE n END) END FROM (SELECT f.*, r.d, r.c, r.k AS nk, list_position(list_transform(f.days, lambda x: abs(x - r.d) <= 1), true) AS p FROM f JOIN r ON r.deal_id = f.deal_id AND r.k = f.k + 1) q JOIN r ON r.deal_id = q.deal_id AND r.k = q.nk),
l AS (SELECT deal_id, days, ns, list_transform(sums, lambda s, i: least(1.0, s + CASE WHEN ns[i] >= 2 THEN 0.1 ELSE 0 END)) AS sure, row_number() OVER (PARTITION BY deal_id ORDER BY k DESC) AS n FROM f)
SELECT deal_id, days[list_position(sure, list_max(sure))] AS date, round(list_max(sure), 6) AS sure, ns[list_position(sure, list_max(sure))] AS sources FROM l WHERE n = 1""")
def enr01_date_votes(v: Views) -> DataFrame:
    """The date that most evidence of each deal agrees on."""
    rows = v.articles.where("published_date IS NOT NULL").select("deal_id", F.col("article_id").alias("seq"), F.col("published_date").alias("date"), ((F.col("article_id") % 7) / 10.0).cast("double").alias("confidence"))
    return merge.date_votes(rows).withColumn("sure", F.round("sure", 6))


@query()
def enr02_best_filings(v: Views) -> DataFrame:
    """The likeliest filing of every deal over all filings; tests hold it against all pairs."""
    deals = v.deals.join(v.companies, "company_id").select("deal_id", "name", F.col("announced_date").alias("date"))
    filings = v.companies.select(F.col("company_id").alias("filing_id"), F.col("name").alias("company"), F.date_sub(F.lit(AS_OF), (F.col("company_id") % 2000).cast("int")).alias("filed"), F.lit("D").alias("form"))
    return likeness.best_filing(deals, filings)


@query("SELECT scan_id FROM scans WHERE status = 'running' AND coalesce(last_heartbeat, started_at) < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 300 SECOND")
def stm04_stuck_scans(v: Views) -> DataFrame:
    return flows.stuck_scans(v.scans, datetime.datetime(2024, 1, 15)).select("scan_id")


@query("SELECT icao, arg_max(altitude, seen_at) AS altitude, max(seen_at) AS seen_at FROM aircraft GROUP BY icao")
def stm01_latest_positions(v: Views) -> DataFrame:
    return flows.latest_positions(v.aircraft).select("icao", "altitude", "seen_at")


@query("SELECT CAST(ts AS DATE) AS day, event_type AS source_name, CAST(sum(event_id % 100) AS BIGINT) AS tokens, count(*) AS calls FROM events GROUP BY 1, 2")
def stm_usage_windows(v: Views) -> DataFrame:
    usage = v.table("events").select("ts", F.col("event_type").alias("source_name"), (F.col("event_id") % 100).alias("tokens"))
    return flows.usage_by_window(usage).select(F.to_date("start").alias("day"), "source_name", "tokens", "calls")


@query()
def str10_page_text(v: Views) -> DataFrame:
    """The text of HTML pages; tests hold the parser against fixed pages."""
    return v.table("pages").select("page_id", F.md5(exports.plain_text(F.col("html"))).alias("text_md5"))


@query("""SELECT c_custkey AS company_id, CASE c_custkey % 4 WHEN 0 THEN 'series_b' WHEN 1 THEN 'pre_seed' WHEN 2 THEN 'series_e_plus' ELSE 'unknown' END AS round_type,
CASE c_custkey % 3 WHEN 0 THEN '$2.5B' WHEN 1 THEN '$30M' ELSE '$500,000' END AS amount, CASE c_custkey % 5 WHEN 0 THEN DATE '2025-12-18' WHEN 1 THEN DATE '2025-12-18' WHEN 2 THEN DATE '2025-12-18' WHEN 3 THEN DATE '2025-12-18' ELSE NULL END AS announced_date, 'Beta' AS participants FROM customer""")
def src19_export_rows(v: Views) -> DataFrame:
    """Deals of an export's rows."""
    k = F.col("c_custkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    rows = v.table("customer").select(
        k.cast("string").alias("Company Name"), pick(["Series B - Acme", "angel", "Series F", "rights"]).alias("Funding Type"), pick(["2500000000", "30000000", "500000"]).alias("Money Raised"),
        pick(["Dec 18, 2025", "2025-12-18", "12/18/2025", "18/12/2025", "-"]).alias("Announced Date"), F.lit("Acme Fund, Gamma").alias("Lead Investors"), F.lit("Gamma, Beta, Acme Fund").alias("Investor Names"),
    )
    out = exports.deals_of_export(rows)
    return out.select(F.col("startup_name").cast("long").alias("company_id"), "round_type", "amount", "announced_date", F.array_join("participants", ",").alias("participants"))


@query("SELECT event_id, CASE CAST(event_id % 22 AS INT) " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(fixed.AIRCRAFT)) + " ELSE 'unknown' END AS kind FROM aircraft")
def map03_aircraft_kinds(v: Views) -> DataFrame:
    kinds = F.array(*map(F.lit, fixed.AIRCRAFT))
    return v.aircraft.select("event_id", F.coalesce(F.try_element_at(kinds, (F.col("event_id") % 22 + 1).cast("int")), F.lit("unknown")).alias("kind"))
