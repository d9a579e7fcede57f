"""Deals as rows for clients, and small forms of addresses, amounts, values and positions over columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, classify, urls
from ledgerloom.operators.rows import deal_rows
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import Views
from ledgerloom.sources import exports


@query("""WITH i AS (SELECT deal_id, string_agg(CASE WHEN is_lead THEN 'lead' ELSE 'non_lead' END, ',' ORDER BY position, is_lead DESC) AS roles, (max({'p': position, 'n': fund_name}) FILTER (WHERE is_lead AND is_tracked_fund)).n AS lead_investor FROM deal_investors JOIN funds USING (fund_id) GROUP BY deal_id),
a AS (SELECT deal_id, arg_min(url, article_id) AS source_url, arg_min(source, article_id) AS source_name FROM articles GROUP BY deal_id)
SELECT d.deal_id, coalesce(c.name, 'Unknown') AS startup_name, coalesce(i.roles, 'stealth') AS investor_roles, d.round_type AS investment_stage, coalesce(CAST(d.amount_usd AS VARCHAR), 'Undisclosed') AS amount_invested, coalesce(strftime(d.announced_date, '%Y-%m-%d'), '') AS date, i.lead_investor,
CASE WHEN c.website LIKE 'http%' THEN c.website END AS company_website, c.linkedin_url AS company_linkedin, a.source_url, a.source_name, CASE WHEN json_valid(d.founders_json) THEN json_extract_string(d.founders_json, '$[0].name') || '|' || CASE WHEN json_extract_string(d.founders_json, '$[0].linkedin_url') LIKE 'http%' AND NOT contains(json_extract_string(d.founders_json, '$[0].linkedin_url'), 'n/a') THEN json_extract_string(d.founders_json, '$[0].linkedin_url') ELSE '' END END AS founders
FROM deals d LEFT JOIN companies c USING (company_id) LEFT JOIN i ON i.deal_id = d.deal_id LEFT JOIN a ON a.deal_id = d.deal_id""")
def prj14_deal_rows(v: Views) -> DataFrame:
    """Every deal as one struct with roles, lead, founders, first article, default amount and ISO date."""
    investors = v.deal_investors.join(v.funds.select("fund_id", F.col("fund_name").alias("investor_name")), "fund_id")
    rows = deal_rows(v.deals.withColumn("amount", F.col("amount_usd").cast("string")), investors, v.companies, v.articles)
    founders = F.array_join(F.transform("row.founders", lambda f: F.concat(f["name"], F.lit("|"), F.coalesce(f["linkedin_url"], F.lit("")))), ",")
    same = ["startup_name", "investment_stage", "amount_invested", "date", "lead_investor", "company_website", "company_linkedin", "source_url", "source_name"]
    return rows.select("deal_id", F.array_join("row.investor_roles", ",").alias("investor_roles"), founders.alias("founders"), *[F.col(f"row.{c}") for c in same])


@query("""SELECT id, url IS NOT NULL AND id % 5 IN (0, 1, 2) AS is_url, CASE WHEN id % 5 IN (0, 1, 2) THEN CASE WHEN id % 5 = 1 THEN 'https://www.' || substr(url, 9) ELSE url END END AS url FROM landed_parts""")
def url04_sanitised(v: Views) -> DataFrame:
    """Addresses as they are, without a scheme, by plain http, as a placeholder and of another scheme, in their https form (URL-01)."""
    bare, k = F.substring("url", 9, 1000), F.col("id") % 5
    raw = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit(" www."), bare)).when(k == 2, F.concat(F.lit("HTTP://"), bare, F.lit(" "))).when(k == 3, F.lit("N/A")).otherwise(F.concat(F.lit("ftp://"), bare))
    return v.landed_parts.select("id", urls.is_url(raw).alias("is_url"), urls.sanitised(raw).alias("url"))


@query("SELECT filing_id, CASE filing_id % 6 WHEN 0 THEN (filing_id % 900 + 1) * 1000000 WHEN 1 THEN (filing_id % 900 + 1) * 1000 WHEN 2 THEN filing_id % 7 * 1000000000 WHEN 3 THEN filing_id WHEN 4 THEN 0 ELSE 0 END AS usd FROM landed_filings")
def amt03_lower_bounds(v: Views) -> DataFrame:
    """Registry amounts with a unit anywhere, of ranges the lower bound; what isn't a number is nought."""
    k = F.col("filing_id")
    n, text = (k % 900 + 1).cast("string"), lambda *parts: F.concat(*parts)
    raw = (
        F.when(k % 6 == 0, text(F.lit("$"), n, F.lit(" - 950M"))).when(k % 6 == 1, text(n, F.lit("K"))).when(k % 6 == 2, text(F.lit("$"), (k % 7).cast("string"), F.lit(" B")))
        .when(k % 6 == 3, F.format_number(k, 0)).when(k % 6 == 4, F.lit("Indefinite"))
    )
    return v.landed_filings.select("filing_id", amounts.lower_bound(raw).alias("usd"))


@query("""WITH r AS (SELECT id, title, substr(coalesce(body, ''), 1, 150) AS body FROM landed_rows), s AS (SELECT id, '`' || chr(8203) || '`' || chr(8203) || '` ' || title || ' user' || chr(8203) || ': -' || chr(8203) || '-' || chr(8203) || '- <' || chr(8203) || 'System> </' || chr(8203) || 'prompt> ' || replace(body, '---', '') || repeat('x', CAST(id % 600 AS INTEGER)) AS v FROM r)
SELECT id, rtrim(CASE WHEN length(v) > 500 THEN substr(v, 1, 500) || '...' ELSE v END, ' ' || chr(9) || chr(10) || chr(13)) AS value FROM s""")
def cls19_prompt_values(v: Views) -> DataFrame:
    """Values with fences, role markers, tags and control characters, as they may stand in a prompt."""
    body = F.replace(F.substring(F.coalesce("body", F.lit("")), 1, 150), F.lit("---"), F.lit(""))
    raw = F.concat(F.lit("  ```\u0007 "), F.col("title"), F.lit(" user: --- <System> </prompt> "), body, F.repeat(F.lit("x"), (F.col("id") % 600).cast("int")))
    return v.landed_rows.select("id", classify.sanitised_value(F.regexp_replace(raw, "^  ", "")).alias("value"))


@query("""WITH s AS (SELECT event_id, 'icao' || CAST(icao AS VARCHAR) AS icao, lat, lon, CAST(altitude AS DOUBLE) AS altitude, on_ground, CAST(event_id % 300 AS DOUBLE) AS speed, CAST(event_id * 11 % 360 AS DOUBLE) AS heading, CAST(least(event_id % 20, 15) AS DOUBLE) AS t FROM aircraft WHERE event_id % 9 <> 4)
SELECT icao || '/' || CAST(event_id AS VARCHAR) AS icao, round(CASE WHEN NOT on_ground AND speed >= 10 THEN lat + speed * t * cos(radians(heading)) / 111320.0 ELSE lat END, 6) AS lat, round(CASE WHEN NOT on_ground AND speed >= 10 THEN lon + speed * t * sin(radians(heading)) / 111320.0 / cos(radians(lat)) ELSE lon END, 6) AS lon FROM s WHERE lat > -90""")
def geo01_predicted_positions(v: Views) -> DataFrame:
    """Positions of a snapshot's states (SRC-24), moved on by the seconds since; states without a place go."""
    k = F.col("event_id")
    s = lambda c: c.cast("string")
    state = F.array(
        F.concat(F.lit("icao"), s(F.col("icao")), F.lit("/"), s(k)), F.lit(" CALL "), F.lit("X"), F.lit("1"), F.lit("1"), F.when(k % 9 != 4, s(F.col("lon"))), s(F.col("lat")), s(F.col("altitude")), s(F.col("on_ground")), s(F.col("on_ground")), s(F.col("on_ground")),
    )
    state = F.concat(F.slice(state, 1, 9), F.array(s((k % 300).cast("double")), s((k * 11 % 360).cast("double"))))
    rows = exports.states_of_snapshot(v.aircraft.where("lat > -90").select(state.alias("state"))).withColumn("t", (F.substring_index("icao", "/", -1).cast("long") % 20).cast("double"))
    moved = exports.predicted(rows, F.col("t"))
    return moved.select("icao", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
