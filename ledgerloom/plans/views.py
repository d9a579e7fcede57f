"""The deal tables, derived from the test tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession

#: "Today" of all queries.
AS_OF = datetime.date(2001, 8, 1)

_TITLES = [
    "Acme raises $25 million series A led by Foo Capital", "Year in review: portfolio spotlight", "Big round for investor",
    "Show HN: a tiny database", "How to apply to startup school", "Funding news from Beta Labs AI",
    "Launch HN: Gamma (YC W24) - agent platform", "GitHub Trending: delta/engine (+150 stars)", "Interview with the founder",
    "Stealth Signal: Epsilon - hiring", "Delaware Filing: Zeta Data Inc", "YC W24: Eta - copilot for enterprise",
]
_LEADS = [
    "The company raised $25 million in a round led by Foo.", "Nothing to announce.", "A protocol on ethereum with staking, token and dao.",
    "Score: 150 comments: 120 llm api", "A neobank with savings account, debit card and mobile payments.", "It secures a seed round of 3 million.",
    "Machine learning platform for enterprise security.", "Total Stars: 12345 language: rust", "A dating app, mobile game and photo editor for individual users.",
    "Founding engineer at a stealth startup, fund: foo", "Registered agent: Stripe Atlas. Formation date: last week. Type: corporation", "Industry: analytics, YC company",
]


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


#: Views by name; names in braces are tables or other views.
VIEWS = {
    "companies": "SELECT c_custkey AS company_id, " + "'Company ' || CAST(c_custkey % 997 AS STRING) || " + _case("c_custkey", ["", ", Inc.", " Labs AI", " Technologies", " LLC", " Health"]) + " AS name, "
    "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '' ELSE 'https://company' || CAST(c_custkey AS STRING) || '.com' END AS website, "
    "CASE WHEN c_custkey % 3 = 0 THEN 'https://linkedin.com/company/c' || CAST(c_custkey AS STRING) END AS linkedin_url FROM {customer}",
    "deals": "SELECT o_orderkey AS deal_id, o_custkey AS company_id, "
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'pre_seed' WHEN '2-HIGH' THEN 'seed' WHEN '3-MEDIUM' THEN 'series_a' WHEN '4-NOT SPECIFIED' THEN 'series_b' ELSE 'series_c' END AS round_type, "
    "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(round(o_totalprice * 1000) AS BIGINT) END AS amount_usd, "
    "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS announced_date, CAST(o_orderdate AS DATE) AS created_date, "
    "o_orderstatus = 'F' AS is_enterprise_ai, o_orderstatus <> 'P' AS is_ai_deal, o_orderkey % 5 = 0 AS is_lead_confirmed, "
    "'category_' || CAST(o_orderkey % 6 AS STRING) AS enterprise_category, o_custkey % 50 AS scan_job_id, "
    "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '[{{\"name\":\"A\",\"linkedin_url\":\"https://www.linkedin.com/in/abc\"}}]' WHEN 2 THEN '[{{\"name\":\"B\",\"linkedin_url\":null}}]' ELSE 'malformed' END AS founders_json FROM {orders}",
    "deal_investors": "SELECT l_orderkey AS deal_id, l_suppkey AS fund_id, CAST(l_linenumber AS BIGINT) AS position, l_linenumber = 1 OR l_partkey % 7 = 0 AS is_lead, l_suppkey % 3 = 0 AS is_tracked_fund FROM {lineitem}",
    "funds": "SELECT s_suppkey AS fund_id, 'fund_' || CAST(s_suppkey AS STRING) AS slug, s_name AS fund_name FROM {supplier}",
    "articles": "SELECT doc_id AS article_id, doc_id * 7 % 1000 AS deal_id, " + _case("doc_id", _TITLES) + " AS title, " + _case("(doc_id * 5)", _LEADS) + " || ' ' || text AS text, source, "
    "'http://Site' || CAST(doc_id % 13 AS STRING) || '.com/a/' || CAST(doc_id % 400 AS STRING) || CASE doc_id % 3 WHEN 0 THEN '/?utm_source=feed&id=1' WHEN 1 THEN '?ref=x#top' ELSE '' END AS url, "
    "CASE WHEN doc_id % 19 = 0 THEN NULL ELSE DATE '2001-05-01' + CAST(doc_id % 90 AS INT) END AS published_date FROM {documents}",
    "usage": "SELECT event_id, CAST(ts AS DATE) AS day, event_type AS source_name, CAST(floor(value * 100) AS BIGINT) AS input_tokens, CAST(floor(value * 7) AS BIGINT) AS output_tokens, "
    "CAST(floor(value * 30) AS BIGINT) AS cache_read_tokens, CAST(floor(value * 3) AS BIGINT) AS cache_write_tokens FROM {events}",
    "scans": "SELECT event_id AS scan_id, user_id, ts AS started_at, CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'success' END AS status, "
    "CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS last_heartbeat, CAST(event_id % 5 AS BIGINT) AS deals_saved, event_type AS trigger_name FROM {events}",
    "signals": "SELECT event_id AS signal_id, 'Company ' || CAST(user_id AS STRING) AS company_name, event_type AS source, CAST(floor(value) AS BIGINT) % 101 AS score, CAST(ts AS DATE) AS spotted_at, "
    "event_id % 10 = 0 AS dismissed, CASE WHEN event_id % 8 = 0 THEN event_id END AS converted_deal_id FROM {events}",
    "tracker": "SELECT o_orderkey AS item_id, CASE o_orderstatus WHEN 'F' THEN 'watching' WHEN 'O' THEN 'contacted' ELSE 'passed' END AS status, o_custkey AS sort_key, 'Company ' || CAST(o_custkey % 300 AS STRING) AS company_name FROM {orders}",
    "snapshots": "SELECT p_brand AS fund_slug, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'prev' ELSE 'cur' END AS side FROM {part}",
    "aircraft": "SELECT event_id, user_id AS icao, ts AS seen_at, value AS altitude, event_type AS category, event_id % 6 = 0 AS on_ground, CAST(event_id % 180 AS DOUBLE) - 90 AS lat, CAST(event_id * 7 % 360 AS DOUBLE) - 180 AS lon FROM {events}",
    "landed_filings": "SELECT c_custkey AS filing_id, CASE c_custkey % 5 WHEN 0 THEN 'Nova ' || CAST(c_custkey AS STRING) || ' Labs Inc' WHEN 1 THEN 'Perplexity SPV-' || CAST(c_custkey AS STRING) WHEN 2 THEN 'Orbit ' || CAST(c_custkey AS STRING) "
    "WHEN 3 THEN 'Beta Fund II' ELSE 'Company ' || CAST(c_custkey AS STRING) END AS company_name, CAST(c_custkey * 7 % 1009 AS STRING) AS cik, DATE '2001-07-31' - CAST(c_custkey % 40 AS INT) AS filing_date, "
    "CASE WHEN c_custkey % 4 = 0 THEN 'D/A' ELSE 'D' END AS form_type, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '$' || CAST(c_custkey % 900 + 1 AS STRING) || ',500,000' WHEN 3 THEN '$0' WHEN 4 THEN '$450,000' ELSE 'Indefinite' END AS amount_raised, "
    "CASE c_custkey % 7 WHEN 0 THEN '$2,000,000' WHEN 1 THEN '$90,000' END AS total_offering, " + _case("c_custkey", ["Technology", "Other Health Care", "Pooled Investment Fund", "Restaurants", ""]) + " AS industry, " + _case("c_custkey", ["DE", "CA", "", "NY"]) + " AS state, "
    "c_custkey % 4 <> 0 AS is_first_sale, CASE c_custkey % 3 WHEN 0 THEN 'Jane Doe|John Roe' WHEN 1 THEN 'Ann ' || CAST(c_custkey AS STRING) ELSE '' END AS persons, 'https://www.sec.gov/Archives/edgar/data/' || CAST(c_custkey AS STRING) AS url, "
    "CASE WHEN c_custkey % 6 = 1 THEN 'accel' END AS fund FROM {customer}",
    "landed_rows": "SELECT doc_id AS id, " + _case("doc_id", _TITLES) + " AS title, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'https://site' || CAST(doc_id % 50 AS STRING) || '.com/p' END AS link, doc_id * 37 % 400 AS score, doc_id * 11 % 130 AS comments, "
    "source AS author, substr(text, 1, CAST(doc_id % 300 AS INT)) AS body, lang, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE DATE '2001-05-01' + CAST(doc_id % 90 AS INT) END AS day, CASE doc_id % 5 WHEN 0 THEN 'accel' WHEN 1 THEN 'usv' WHEN 2 THEN '' END AS fund FROM {documents}",
    "landed_parts": "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS kind, CAST(p_size AS BIGINT) AS size, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'https://host' || CAST(p_partkey AS STRING) || '.io' END AS url, DATE '2001-01-01' + CAST(p_partkey % 200 AS INT) AS day FROM {part}",
}


def with_views(sql: str) -> str:
    """SQL with the views that it names in front of it."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    tables = {t: t for t in ("customer", "orders", "lineitem", "supplier", "documents", "events", "part", "pages", "nation")}
    ctes = ", ".join(f"{n} AS ({VIEWS[n].format(**tables)})" for n in used)
    if not used:
        return sql
    rest = sql.strip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {rest[15:]}"
    return f"WITH {ctes}, {rest[5:]}" if rest.upper().startswith("WITH ") else f"WITH {ctes} {sql}"


class Views:
    """The views over the tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        text = VIEWS[name]
        needed = re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)
        return self.spark.sql(text, **{t: self.table(t) for t in needed})
