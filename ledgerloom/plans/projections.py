"""Articles made from landed filings, posts, repositories, companies, jobs, marks, tweets and news."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fixed, projections
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import AS_OF, Views


def shown(rows: DataFrame, key: str, columns: list) -> DataFrame:
    """The article of every row, its text as a digest."""
    a = rows.select(F.col(key).alias("id"), *columns)
    return a.select("id", "url", "title", F.md5("text").alias("text_md5"), "published_date", "author", F.array_join("tags", ",").alias("tags"), "fund_slug")


def _sql(table: str, key: str, url: str, title: str, text: str, day: str, author: str, tags: str, fund: str = "''") -> str:
    return f"SELECT {key} AS id, {url} AS url, {title} AS title, md5({text}) AS text_md5, CAST({day} AS DATE) AS published_date, {author} AS author, concat_ws(',', {tags}) AS tags, {fund} AS fund_slug FROM {table}"


def _lines(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


_FILING = _lines(
    "'SEC Form D Filing: ' || company_name", "'Filing Date: ' || CAST(filing_date AS VARCHAR)", "'Form Type: ' || form_type", "'Amount Raised: ' || nullif(amount_raised, '')", "'Total Offering: ' || total_offering",
    "'Related Persons: ' || nullif(replace(persons, '|', ', '), '')", "'Industry: ' || nullif(industry, '')", "'State of Incorporation: ' || nullif(state, '')",
    "CASE WHEN is_first_sale THEN 'Note: This is the FIRST sale under this offering.' END", "chr(10) || 'SEC Filing URL: ' || url",
)


def filings(v: Views) -> DataFrame:
    return v.landed_filings.withColumn("investors", F.filter(F.split("persons", r"\|"), lambda x: x != ""))


@query(_sql("landed_filings", "filing_id", "url", "'SEC Form D: ' || company_name || ' - ' || coalesce(nullif(amount_raised, ''), 'Amount TBD')", _FILING, "filing_date", "'SEC EDGAR'",
            "'sec', 'form_d', form_type, CASE WHEN state = 'DE' THEN 'delaware' END", "coalesce(fund, '')"))
def prj01_filing_articles(v: Views) -> DataFrame:
    return shown(filings(v), "filing_id", projections.of_filing())


@query("SELECT filing_id, n AS sec_amount_usd, CASE WHEN n <> 0 THEN 'sec_form_d' END AS amount_source FROM (SELECT filing_id, TRY_CAST(replace(replace(amount_raised, '$', ''), ',', '') AS BIGINT) AS n FROM landed_filings)")
def prj01_filing_amounts(v: Views) -> DataFrame:
    return filings(v).select("filing_id", *projections.of_filing()).select("filing_id", "sec_amount_usd", "amount_source")


_KIND = "CASE WHEN starts_with(lower(title), 'launch hn') THEN 'launch_hn' WHEN starts_with(lower(title), 'show hn') THEN 'show_hn' WHEN starts_with(lower(title), 'ask hn') THEN 'ask_hn' ELSE 'story' END"
_ITEM = "'https://news.ycombinator.com/item?id=' || CAST(id AS VARCHAR)"


@query(_sql("landed_rows", "id", f"coalesce(nullif(link, ''), {_ITEM})", "title", _lines(
    "'Hacker News: ' || title", f"'Type: ' || {_KIND}", "'Score: ' || CAST(score AS VARCHAR) || ' points'", "'Comments: ' || CAST(comments AS VARCHAR)", "'Author: ' || author", "chr(10) || nullif(body, '')",
    "chr(10) || 'Link: ' || nullif(link, '')", f"'HN Discussion: ' || {_ITEM}"), "day", "author", f"'hackernews', {_KIND}", "coalesce(fund, '')"))
def prj02_story_articles(v: Views) -> DataFrame:
    return shown(v.landed_rows.withColumn("story_id", F.col("id")), "id", projections.of_story())


@query(f"SELECT id, {_KIND} AS kind FROM (SELECT id, CASE WHEN id % 7 = 0 THEN 'Ask HN: ' || title ELSE title END AS title FROM landed_rows)")
def prj03_story_types(v: Views) -> DataFrame:
    title = F.when(F.col("id") % 7 == 0, F.concat(F.lit("Ask HN: "), "title")).otherwise(F.col("title"))
    return v.landed_rows.select("id", projections.story_type(title).alias("kind"))


_PAGE = "'https://github.com/' || replace(name, ' ', '/')"


def _thousands(x: str) -> str:
    return f"format('{{:,}}', {x})"


@query(_sql("landed_parts", "id", _PAGE, "'GitHub Trending: ' || name || ' (+' || CAST(size AS VARCHAR) || ' stars) - ' || substr(name || ' ' || kind, 1, 80)", _lines(
    "'GitHub Trending: ' || name", "'Description: ' || name || ' ' || kind", "'Language: ' || CASE WHEN id % 4 = 0 THEN 'Unknown' ELSE kind END", f"'Stars Today: ' || {_thousands('size')}",
    f"'Total Stars: ' || {_thousands('size * 1237')}", f"'Forks: ' || {_thousands('size * 31')}", "CASE WHEN id % 3 = 0 THEN NULL ELSE 'Top Contributors: ' || brand || ', ' || kind END", f"chr(10) || 'GitHub URL: ' || {_PAGE}",
    "CASE WHEN id % 5 = 0 THEN chr(10) || '--- README ---' || chr(10) || substr(repeat(name, 300), 1, 2000) END"), "NULL", "CASE WHEN id % 3 = 0 THEN NULL ELSE brand END",
    "'github', 'trending', CASE WHEN id % 4 = 0 THEN 'unknown' ELSE lower(kind) END"))
def prj04_repository_articles(v: Views) -> DataFrame:
    k = F.col("id")
    rows = v.landed_parts.select(
        "id", "name", F.concat(F.lit("https://github.com/"), F.replace("name", F.lit(" "), F.lit("/"))).alias("url"), F.concat_ws(" ", "name", "kind").alias("description"), F.when(k % 4 != 0, F.col("kind")).alias("language"),
        F.col("size").alias("stars_today"), (F.col("size") * 1237).alias("total_stars"), (F.col("size") * 31).alias("forks"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("brand", "kind")).alias("built_by"),
        F.when(k % 5 == 0, F.repeat("name", F.lit(300))).alias("readme"),
    )
    return shown(rows, "id", projections.of_repository())


@query(_sql("landed_rows", "id", "'https://www.ycombinator.com/companies/' || author", "'YC W' || CAST(20 + id % 6 AS VARCHAR) || ': ' || author || ' - ' || substr(body, 1, 100)", _lines(
    "'Y Combinator Company: ' || author", "'Batch: W' || CAST(20 + id % 6 AS VARCHAR)", "'Description: ' || body", "'Industry: ' || nullif(fund, '')", "'Location: ' || lang", "'Website: ' || nullif(link, '')",
    "chr(10) || 'YC Profile: ' || 'https://www.ycombinator.com/companies/' || author", "chr(10) || 'Note: Y Combinator Demo Day company - potential early-stage investment opportunity'"), "NULL", "'Y Combinator'",
    "'ycombinator', 'demo_day', 'W' || CAST(20 + id % 6 AS VARCHAR), lower(nullif(fund, ''))"))
def prj05_batch_articles(v: Views) -> DataFrame:
    rows = v.landed_rows.select(
        "id", F.col("author").alias("name"), F.concat(F.lit("https://www.ycombinator.com/companies/"), "author").alias("url"), F.col("body").alias("description"), F.concat(F.lit("W"), (F.col("id") % 6 + 20).cast("string")).alias("batch"),
        F.col("fund").alias("industry"), F.col("lang").alias("location"), F.col("link").alias("website"),
    )
    return shown(rows, "id", projections.of_batch_company())


@query(_sql("landed_rows", "id", "coalesce(link, 'none')", "'Stealth Signal: ' || author || ' - ' || substr(title, 1, 50)", _lines(
    "CASE WHEN id % 2 = 0 THEN '[STEALTH STARTUP DETECTED]' END", "'STEALTH SIGNAL: LinkedIn Job Posting'", "'Company: ' || author", "'Job: ' || title", "''", "'Description: ' || body", "''", "'LinkedIn URL: ' || coalesce(link, 'none')",
    "chr(10) || 'Matched Fund: ' || nullif(fund, '')"), f"coalesce(day, DATE '{AS_OF}')", "'LinkedIn Jobs'", "'linkedin_jobs', 'stealth_signal', CASE WHEN id % 2 = 0 THEN 'stealth' END, 'fund:' || nullif(fund, '')", "coalesce(fund, '')"))
def prj06_job_articles(v: Views) -> DataFrame:
    rows = v.landed_rows.select("id", F.coalesce("link", F.lit("none")).alias("url"), "title", F.col("author").alias("company_name"), F.col("body").alias("description"), (F.col("id") % 2 == 0).alias("is_stealth"), "fund", F.col("day").alias("posted_date"))
    return shown(rows, "id", projections.of_job(AS_OF))


@query(_sql("landed_parts", "id", "coalesce(url, 'https://icis.corp.delaware.gov/')", "'Delaware Filing: ' || name", _lines(
    "'[DELAWARE INCORPORATION DETECTED]'", "''", "'Entity: ' || name", "'Type: ' || kind", "'Status: Active'", "CASE WHEN id % 2 = 0 THEN 'File Number: ' || CAST(id AS VARCHAR) END", "CASE WHEN id % 4 <> 0 THEN 'Formation Date: ' || CAST(day AS VARCHAR) END",
    "CASE WHEN id % 5 = 0 THEN 'Registered Agent: ' || brand END", "''", "'Signals: ' || coalesce(nullif(concat_ws(', ', CASE WHEN id % 3 = 0 THEN 'Tech company name pattern' END, CASE WHEN id % 5 = 0 THEN 'Startup-friendly registered agent' END), ''), 'None')",
    "''", "'Note: ~67% of VC-backed startups incorporate in Delaware.'", "'New tech company formations may indicate upcoming funding.'", "chr(10) || 'Source: ' || url"), "CASE WHEN id % 4 <> 0 THEN day END", "'Delaware Division of Corporations'",
    "'delaware', 'incorporation', 'stealth_signal', CASE WHEN id % 3 = 0 THEN 'tech_name' END, CASE WHEN id % 5 = 0 THEN 'startup_agent' END"))
def prj07_entity_articles(v: Views) -> DataFrame:
    k = F.col("id")
    rows = v.landed_parts.select(
        "id", F.col("name").alias("entity_name"), F.col("kind").alias("entity_type"), F.lit("Active").alias("status"), F.when(k % 2 == 0, k.cast("string")).alias("file_number"), F.when(k % 4 != 0, F.col("day")).alias("formation_date"),
        F.when(k % 5 == 0, F.col("brand")).alias("registered_agent"), F.col("url").alias("source_url"), (k % 3 == 0).alias("has_tech_name"), (k % 5 == 0).alias("has_startup_agent"),
    )
    return shown(rows, "id", projections.of_entity())


_SERIAL = "lpad(CAST(id AS VARCHAR), 8, '9')"


@query(_sql("landed_parts", "id", f"coalesce(url, 'https://tsdr.uspto.gov/#caseNumber=' || {_SERIAL})", "'USPTO Filing: ' || name", _lines(
    "chr(128203) || ' USPTO TRADEMARK APPLICATION'", "''", "'Mark: ' || name", "'Filing Date: ' || CAST(day AS VARCHAR)", f"'Serial Number: ' || {_SERIAL}", "'Nice Class: 009'", "''", "'Applicant: ' || CASE WHEN id % 2 = 0 THEN brand ELSE 'Not disclosed' END", "''",
    "'Goods/Services: ' || kind", "''", "'Note: Trademark applications are often filed BEFORE company announcements.'", "'This could indicate a new startup or product launch.'", "chr(10) || 'USPTO URL: ' || url"), "day", "'USPTO'",
    "'uspto', 'trademark', 'stealth_signal', 'class_009'"))
def prj08_trademark_articles(v: Views) -> DataFrame:
    k = F.col("id")
    rows = v.landed_parts.select(
        "id", F.col("name").alias("mark_text"), F.col("day").alias("filing_date"), F.lpad(k.cast("string"), 8, "9").alias("serial_number"), F.lit("009").alias("nice_class"), F.when(k % 2 == 0, F.col("brand")).otherwise("").alias("applicant_name"),
        F.col("kind").alias("goods_services"), "url",
    )
    return shown(rows, "id", projections.of_trademark())


@query(_sql("landed_rows", "id", "'https://x.com/' || CAST(id AS VARCHAR)", "'@' || lang || ': ' || substr(body, 1, 100) || CASE WHEN length(body) > 100 THEN '...' ELSE '' END", "body", "day", "author", "'twitter', lang"))
def prj09_tweet_articles(v: Views) -> DataFrame:
    rows = v.landed_rows.select("id", F.concat(F.lit("https://x.com/"), F.col("id").cast("string")).alias("url"), "body", F.col("lang").alias("username"), "author", "day")
    return shown(rows, "id", projections.of_tweet())


_FUNDS = ["accel", "khosla", "elsewhere", "usv", "thrive"]
_SLUG = "CASE id % 5 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_FUNDS)) + " END"
_ADDED = f"(CASE id % 5 WHEN 0 THEN '{fixed.PORTFOLIO_PAGES['accel']}' WHEN 1 THEN '{fixed.PORTFOLIO_PAGES['khosla']}' WHEN 3 THEN 'https://www.usv.com/companies' ELSE 'https://' || {_SLUG} || '.com/portfolio' END || '#' || replace(lower(name), ' ', '-'))"


@query(_sql("landed_parts", "id", f"coalesce(url, {_ADDED})", f"'Stealth Addition: ' || name || ' added to ' || {_SLUG} || ' portfolio'", _lines(
    "'[STEALTH PORTFOLIO ADDITION DETECTED]'", "''", f"'Fund: ' || {_SLUG}", "'Company: ' || name", "'First Seen: ' || CASE WHEN id % 6 = 0 THEN 'None' ELSE CAST(day AS VARCHAR) END", "''",
    f"'This company was just added to ' || {_SLUG} || '''s portfolio page.'", "'This often happens BEFORE any public funding announcement.'", "chr(10) || 'Portfolio URL: ' || url"), f"CASE WHEN id % 6 = 0 THEN DATE '{AS_OF}' ELSE day END",
    f"{_SLUG} || ' Portfolio'", f"'portfolio_diff', 'stealth', 'pre_announcement', {_SLUG}", _SLUG))
def prj10_addition_articles(v: Views) -> DataFrame:
    slug = F.element_at(F.array(*map(F.lit, _FUNDS)), (F.col("id") % 5 + 1).cast("int"))
    return shown(v.landed_parts.select("id", slug.alias("fund_slug"), "name", "url", F.when(F.col("id") % 6 != 0, F.col("day")).alias("first_seen")), "id", projections.of_addition(AS_OF))


_BRIEF = _lines("'Headline: ' || title", "'Source: ' || author", "'Fund: ' || coalesce(fund, 'none')", "nullif(substr(body, 1, 20), '')")


@query(_sql("landed_rows", "id", "coalesce(nullif(link, ''), 'https://news.google.com/' || CAST(id AS VARCHAR))", "title", f"CASE WHEN length(body) > 200 THEN 'Headline: ' || title || chr(10) || 'Source: ' || author || chr(10) || 'Fund Context: ' || coalesce(fund, 'none') || chr(10) || chr(10) || 'Article Content:' || chr(10) || body ELSE {_BRIEF} END",
            f"coalesce(day, DATE '{AS_OF}')", "author", "'google_news', fund", "coalesce(fund, '')"))
def prj11_news_articles(v: Views) -> DataFrame:
    rows = v.landed_rows.select(
        "id", F.concat(F.lit("https://news.google.com/"), F.col("id").cast("string")).alias("url"), F.col("link").alias("real_url"), "title", F.col("author").alias("source"), F.coalesce("fund", F.lit("none")).alias("fund_name"), "fund",
        F.substring("body", 1, 20).alias("description"), F.col("body").alias("full_text"), "day",
    )
    return shown(rows, "id", projections.of_news(AS_OF))


@query("SELECT id, md5(CASE WHEN id % 6 = 0 THEN body ELSE 'ARTICLE TITLE: ' || title || chr(10) || chr(10) || body END) AS text_md5 FROM landed_rows")
def prj12_texts_with_titles(v: Views) -> DataFrame:
    title = F.when(F.col("id") % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), "title", F.lit(" ")))
    return v.landed_rows.select("id", F.md5(projections.with_title(title, F.col("body"))).alias("text_md5"))


_ROUNDS = ["Seed", "series B ", "SERIES E", "series h", "angel", "Pre-Seed", "growth"]
_LEADS = ["Accel", "Nobody Capital", "Sequoia Capital", "Benchmark International"]
_ROUND_SQL = "CASE id % 7 WHEN 0 THEN 'seed' WHEN 1 THEN 'series_b' WHEN 2 THEN 'series_e_plus' WHEN 3 THEN 'series_e_plus' WHEN 4 THEN 'unknown' WHEN 5 THEN 'pre_seed' ELSE 'growth' END"
_LEAD_SQL = "CASE id % 4 WHEN 0 THEN 'Accel' WHEN 1 THEN 'Nobody Capital' WHEN 2 THEN 'Sequoia Capital' ELSE 'Benchmark International' END"


@query(f"""SELECT id, {_ROUND_SQL} AS round_label, CASE WHEN id % 3 = 2 THEN NULL ELSE day END AS round_date, id % 4 IN (0, 2) AS tracked_fund_is_lead, CASE WHEN id % 4 IN (0, 2) THEN {_LEAD_SQL} END AS tracked_fund_name,
'Lead investors: ' || {_LEAD_SQL} AS verification_snippet, CASE WHEN id % 2 = 0 THEN 'security' ELSE 'not_ai' END AS enterprise_category, 0.95 AS confidence_score FROM landed_parts""")
def prj13_structured_deals(v: Views) -> DataFrame:
    k = F.col("id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    day = F.when(k % 3 == 0, F.date_format("day", "yyyy-MM-dd")).when(k % 3 == 1, F.date_format("day", "MMM d, yyyy")).otherwise("soon")
    rows = v.landed_parts.select(
        "id", F.col("name").alias("startup_name"), F.lit(None).cast("string").alias("description"), F.col("url").alias("website"), pick(_ROUNDS).alias("round_type"), F.lit("$5M").alias("amount"), day.alias("announced_date"),
        F.array(pick(_LEADS)).alias("lead_investors"), F.array(F.lit("Baz")).alias("participants"), F.when(k % 2 == 0, F.array(F.lit("AI"), F.lit("Cybersecurity"))).otherwise(F.array(F.lit("Farming"))).alias("industries"),
    )
    out = rows.select("id", *projections.of_structured_deal())
    return out.select("id", "round_label", "round_date", "tracked_fund_is_lead", "tracked_fund_name", "verification_snippet", "enterprise_category", "confidence_score")


@query(f"SELECT id, startup_name FROM (SELECT id, name AS startup_name, {_LEAD_SQL} AS lead FROM landed_parts) WHERE lead IN ('Accel', 'Sequoia Capital')")
def src20_tracked_leads(v: Views) -> DataFrame:
    """Of a batch of structured deals, those that a tracked fund leads."""
    lead = F.element_at(F.array(*map(F.lit, _LEADS)), (F.col("id") % 4 + 1).cast("int"))
    from ledgerloom.functions.funds import matched_fund

    return v.landed_parts.where(matched_fund(lead).isNotNull()).select("id", F.col("name").alias("startup_name"))


@query("""WITH s AS (SELECT id, unnest(['alpha', 'beta', 'total_deals_saved']) AS source, unnest([0, 1, 2]) AS shift FROM landed_parts WHERE id % 5 <> 0), k AS (SELECT id, source, (id + shift) % 4 AS kind FROM s WHERE source <> 'total_deals_saved')
SELECT id, source, CASE kind WHEN 0 THEN 7 WHEN 1 THEN 5 ELSE 0 END AS articles_found, CASE WHEN kind = 0 THEN 2 ELSE 0 END AS deals_saved, CASE WHEN kind = 1 THEN 1 ELSE 0 END AS errors, CASE WHEN kind = 2 THEN 'timed out' END AS error_message FROM k WHERE kind <> 3""")
def prj15_scan_sources(v: Views) -> DataFrame:
    from ledgerloom.operators.scans import source_results

    part = lambda shift: F.element_at(F.array(*map(F.lit, ['{"articles_received": 7, "deals_saved": 2}', '{"articles_found": 5, "errors": 1}', '{"error": "timed out"}', "3"])), ((F.col("id") + shift) % 4 + 1).cast("int"))
    raw = F.concat(F.lit('{"alpha": '), part(0), F.lit(', "beta": '), part(1), F.lit(', "total_deals_saved": '), part(2), F.lit("}"))
    return source_results(v.landed_parts.select("id", F.when(F.col("id") % 5 == 0, "malformed").otherwise(raw).alias("raw")), "id", "raw").select("id", "source", "articles_found", "deals_saved", "errors", "error_message")


@query("""SELECT d.deal_id, c.name AS company_name, d.round_type, d.amount_usd, p.partner AS lead_investor, c.website FROM deals d JOIN companies c USING (company_id) LEFT JOIN (SELECT deal_id, 'Partner ' || CAST(min(fund_id) AS VARCHAR) AS partner FROM deal_investors WHERE is_lead GROUP BY deal_id) p USING (deal_id)
WHERE d.deal_id NOT IN (SELECT item_id FROM tracker WHERE status = 'watching')""")
def prj16_tracker_items(v: Views) -> DataFrame:
    """Deals as tracker items, unless they are tracked already; the lead's partner stands for the lead."""
    partner = v.deal_investors.where("is_lead").groupBy("deal_id").agg(F.concat(F.lit("Partner "), F.min("fund_id").cast("string")).alias("lead_investor"))
    fresh = v.deals.join(v.tracker.where("status = 'watching'").select(F.col("item_id").alias("deal_id")), "deal_id", "left_anti")
    return fresh.join(v.companies, "company_id").join(partner, "deal_id", "left").select("deal_id", F.col("name").alias("company_name"), "round_type", "amount_usd", "lead_investor", "website")


_MARKED = "CASE WHEN fund = 'bessemer' AND contains(lower(title || ' ' || body), 'bvp forge') THEN '[BVP FORGE - PE/BUYOUT]' || chr(10) || body WHEN fund = 'usv' AND contains(lower(body), 'we are leading') THEN '[USV IS LEADING]' || chr(10) || body ELSE body END"


@query(f"SELECT id, md5({_MARKED}) AS text_md5 FROM (SELECT id, title || CASE WHEN id % 6 = 0 THEN ' BVP Forge' ELSE '' END AS title, body || CASE WHEN id % 8 = 1 THEN ' We are leading it' ELSE '' END AS body, CASE id % 3 WHEN 0 THEN 'bessemer' WHEN 1 THEN 'usv' ELSE 'accel' END AS fund FROM landed_rows)")
def apx05_marked_texts(v: Views) -> DataFrame:
    k = F.col("id")
    title, body = F.concat("title", F.when(k % 6 == 0, " BVP Forge").otherwise("")), F.concat("body", F.when(k % 8 == 1, " We are leading it").otherwise(""))
    fund = F.when(k % 3 == 0, "bessemer").when(k % 3 == 1, "usv").otherwise("accel")
    return v.landed_rows.select("id", F.md5(projections.marked_text(fund, title, body)).alias("text_md5"))


_QUERIED = {s: f'"{n}" AND ("led by" OR leads OR led) AND (funding OR raises OR "Series A" OR "Series B")' for s, n in (("accel", "Accel Partners"), ("usv", "Union Square Ventures"), ("gv", "Google Ventures"))}


@query(f"""SELECT id, CASE fund WHEN 'accel' THEN '{_QUERIED['accel']} -"Accel Entertainment"' WHEN 'usv' THEN '{_QUERIED['usv']}' WHEN 'gv' THEN '{_QUERIED['gv']} -"NYSE:GV" -"GV stock" -"Visionary Holdings" -"GV ticker"' ELSE '' END AS search,
'(' || CASE WHEN id % 2 = 0 THEN '"AI SaaS" OR "enterprise AI" OR "B2B AI"' ELSE '"enterprise AI" OR "AI startup" OR "AI infrastructure"' END || ') AND (funding OR raises) AND (led OR leads)' AS enterprise FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'accel' WHEN 1 THEN 'usv' WHEN 2 THEN 'gv' ELSE 'nobody' END AS fund FROM landed_parts)""")
def src15_searches(v: Views) -> DataFrame:
    k = F.col("id")
    fund = F.when(k % 4 == 0, "accel").when(k % 4 == 1, "usv").when(k % 4 == 2, "gv").otherwise("nobody")
    category = F.when(k % 2 == 0, "vertical_saas").otherwise("other")
    return v.landed_parts.select("id", projections.fund_query(fund, fixed.QUERY_FUNDS).alias("search"), projections.enterprise_query(category).alias("enterprise"))
