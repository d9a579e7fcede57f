"""Filings, registries, exports and profiles over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import classify, dates, fixed, names, urls
from ledgerloom.operators import registry as ops
from ledgerloom.plans.registry import list_sql, query, words_sql
from ledgerloom.plans.views import Views


def _pick(key: str, values: list):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _pick_sql(key: str, values: list) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN " + ("NULL" if x is None else f"'{x}'") for k, x in enumerate(values)) + " END"


_NAMES = ["Acme Fund III, LP", "Perplexity SPV-2", "Foo Holdings, LLC", "SP-1216 Fundamentals", "Sequoia Capital", "Acme", "Fundrise", "Beta Fund"]
_LOW = f"lower({_pick_sql('deal_id', _NAMES)})"


@query(f"""SELECT deal_id, CASE WHEN regexp_matches({_LOW}, '{fixed.FUND_NAME_END}') THEN 'fund name' WHEN regexp_matches({_LOW}, '{fixed.SPECIAL_VEHICLE}') THEN 'special vehicle' WHEN regexp_matches({_LOW}, ',\\s*(lp|llc|llp)$') THEN 'legal form'
WHEN regexp_matches({_pick_sql('deal_id', _NAMES)}, '^[A-Z]{{2,4}}-\\d{{3,}}') AND contains({_LOW}, 'fund') THEN 'fund code' WHEN deal_id % 8 = 4 THEN 'tracked fund' WHEN coalesce(amount_usd, 0) >= 1000000000 THEN 'fund raise' END AS reason FROM deals""")
def cls09_fund_structures(v: Views) -> DataFrame:
    return v.deals.select("deal_id", classify.fund_structure(_pick("deal_id", _NAMES), F.lit("a new fund"), F.col("amount_usd")).alias("reason"))


_KINDS = ["Artificial Intelligence|Cybersecurity", "Machine Learning|Retail", "Blockchain|AI", "Robotics|Big Data", "Software|Computer Vision", "Farming", "Generative AI|Payments", "NLP"]
_IND = f"lower({_pick_sql('deal_id', _KINDS)})"
_ANY = {k: words_sql(_IND, w) for k, w in fixed.INDUSTRIES.items()}


@query(f"""SELECT deal_id, CASE WHEN {_ANY['crypto']} OR NOT {_ANY['ai']} THEN 'not_ai' WHEN {_ANY['consumer']} THEN 'not_ai' WHEN {_ANY['security']} THEN 'security' WHEN {_ANY['vertical_saas']} THEN 'vertical_saas' WHEN {_ANY['data_intelligence']} THEN 'data_intelligence'
WHEN {_ANY['infrastructure']} THEN 'infrastructure' WHEN contains({_IND}, 'software') OR contains({_IND}, 'developer') THEN 'infrastructure' ELSE 'not_ai' END AS category, {_ANY['ai']} AND NOT {_ANY['crypto']} AS is_ai FROM deals""")
def cls11_industry_classes(v: Views) -> DataFrame:
    found = classify.ai_of_industries(F.split(_pick("deal_id", _KINDS), r"\|"), F.lit(None).cast("string"))
    return v.deals.select("deal_id", found["category"].alias("category"), found["is_ai"].alias("is_ai"))


_FILED = ["Technology", "Other Health Care", "Pooled Investment Fund", "Restaurants", None]


@query(f"""SELECT deal_id, {words_sql(f"lower(coalesce({_pick_sql('deal_id', _FILED)}, ''))", fixed.BACKED_INDUSTRIES)} AND (coalesce(amount_usd, 0) >= 500000 OR is_ai_deal) AS backed FROM deals""")
def pre33_likely_backed(v: Views) -> DataFrame:
    raised = F.concat(F.lit("$"), F.format_number("amount_usd", 0))
    return v.deals.select("deal_id", classify.likely_backed(_pick("deal_id", _FILED), raised, F.lit(None).cast("string"), F.col("is_ai_deal")).alias("backed"))


@query(f"SELECT source, count(*) AS articles, count(*) FILTER (WHERE {words_sql('lower(title)', fixed.FEED_WORDS)}) AS funding, count(*) FILTER (WHERE {words_sql('lower(title)', fixed.FEED_AI_WORDS)}) AS enterprise_ai FROM articles GROUP BY source")
def pre26_feed_tests(v: Views) -> DataFrame:
    from ledgerloom.functions.text import has_any

    low = F.lower("title")
    return v.articles.groupBy("source").agg(F.count("*").alias("articles"), F.count_if(has_any(low, fixed.FEED_WORDS)).alias("funding"), F.count_if(has_any(low, fixed.FEED_AI_WORDS)).alias("enterprise_ai"))


_PROFILES = ["https://linkedin.com/in/bob-wilson-mba", "https://www.linkedin.com/in/mary-jane-watson", "https://linkedin.com/in/jsmith123", "https://linkedin.com/company/x-y", "https://linkedin.com/in/john-q-smith"]
_PEOPLE = ["Bob Wilson", "Mary Jane", None, None, "John Smith"]


@query(f"SELECT company_id, {_pick_sql('company_id', _PEOPLE)} AS person FROM companies")
def str07_profile_names(v: Views) -> DataFrame:
    return v.companies.select("company_id", names.profile_name(_pick("company_id", _PROFILES)).alias("person"))


@query("SELECT company_id, regexp_replace(regexp_replace(regexp_replace(lower(name), '[[:space:]-]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '^_+|_+$', '', 'g') AS slug FROM companies")
def str04_slugs(v: Views) -> DataFrame:
    return v.companies.select("company_id", names.slug(F.col("name")).alias("slug"))


_AGO = ["6 months ago", "2 years ago", "3 weeks ago", "late last year", "earlier this year", "soon"]


@query("""SELECT deal_id, CASE deal_id % 6 WHEN 0 THEN CAST(created_date - INTERVAL 6 MONTH AS DATE) WHEN 1 THEN CAST(created_date - INTERVAL 24 MONTH AS DATE) WHEN 2 THEN created_date - 21 WHEN 3 THEN CAST(created_date - INTERVAL 12 MONTH AS DATE) WHEN 4 THEN make_date(year(created_date), 6, 1) END AS day FROM deals""")
def date06_article_dates(v: Views) -> DataFrame:
    return v.deals.select("deal_id", dates.article_relative(_pick("deal_id", _AGO), F.col("created_date")).alias("day"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN DATE '2024-07-01' END AS month, CASE WHEN page_id % 2 = 0 THEN 'https://a.b/c?d=1' END AS target FROM pages")
def url_parts(v: Views) -> DataFrame:
    """Months in addresses and targets of redirects."""
    dated = F.when(F.col("page_id") % 3 == 0, "https://x.y/2024/07/z").otherwise("https://x.y/2024/z")
    redirect = F.when(F.col("page_id") % 2 == 0, "https://www.google.com/url?rct=j&url=https%3A%2F%2Fa.b%2Fc%3Fd%3D1&ct=ga").otherwise("https://www.google.com/url?rct=j")
    target = F.regexp_extract(F.try_url_decode(redirect), r"[?&]url=(https?://[^&]*)", 1)
    return v.table("pages").select("page_id", dates.of_url(dated).alias("month"), F.when(target != "", target).alias("target"))


_ENTITY = "CASE company_id % 4 WHEN 0 THEN 'x' || name || 'y' WHEN 1 THEN split_part(name, ' ', 2) || ' Labs of Company' ELSE 'Entity ' || CAST(company_id * 31 % 977 AS VARCHAR) END"


@query(f"""WITH f AS (SELECT company_id AS filing_id, lower(trim(regexp_replace(name, '\\s*(Inc[.]?|LLC|Corp[.]?|Corporation|Ltd[.]?)$', '', 'i'))) AS a FROM companies), e AS (SELECT company_id AS entity_id, lower({_ENTITY}) AS b FROM companies),
m AS (SELECT filing_id, entity_id, a, b, list_distinct(string_split_regex(a, '\\s+')) AS x, list_distinct(string_split_regex(b, '\\s+')) AS y FROM f, e)
SELECT filing_id, min(entity_id) AS entity_id FROM m WHERE contains(a, b) OR contains(b, a) OR len(list_intersect(x, y)) >= least(2, len(x)) GROUP BY filing_id""")
def join08_registry_matches(v: Views) -> DataFrame:
    filings = v.companies.select(F.col("company_id").alias("filing_id"), F.col("name").alias("company"))
    k, number = F.col("company_id"), F.element_at(F.split("name", " "), 2)
    entity = F.when(k % 4 == 0, F.concat(F.lit("x"), "name", F.lit("y"))).when(k % 4 == 1, F.concat(number, F.lit(" Labs of Company"))).otherwise(F.concat(F.lit("Entity "), (k * 31 % 977).cast("string")))
    return ops.match_entities(filings, v.companies.select(k.alias("entity_id"), entity.alias("entity")))


@query("""WITH r AS (SELECT trigger_name AS source, scan_id AS seq, status = 'failed' AS failed FROM scans), g AS (SELECT *, coalesce(sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS good FROM r),
s AS (SELECT *, coalesce(sum(CAST(failed AS INT)) OVER (PARTITION BY source, good ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS streak FROM g) SELECT source, seq FROM s WHERE streak >= 2""")
def sco11_tripped_runs(v: Views) -> DataFrame:
    runs = v.scans.select(F.col("trigger_name").alias("source"), F.col("scan_id").alias("seq"), (F.col("status") == "failed").alias("failed"))
    return ops.tripped(runs, 2).select("source", "seq")


@query("SELECT c.company_id, a.company_id AS alias_of FROM companies c LEFT JOIN (SELECT lower(trim(name)) AS k, min(company_id) AS company_id FROM companies WHERE company_id % 3 = 0 GROUP BY 1) a ON lower(trim(c.name)) = a.k")
def join06_aliases(v: Views) -> DataFrame:
    aliases = v.companies.where("company_id % 3 = 0").select(F.col("name").alias("alias_name"), F.col("company_id"))
    named = v.companies.select(F.col("company_id").alias("own"), F.upper("name").alias("name"))
    return ops.by_alias(named, aliases).select(F.col("own").alias("company_id"), F.col("company_id").alias("alias_of"))


@query(f"SELECT part.p_partkey AS id, CASE WHEN p_type IN {list_sql(['ECONOMY', 'STANDARD'])} THEN 'DE' END AS state FROM part")
def map02_states(v: Views) -> DataFrame:
    state = F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "Delaware").otherwise("Atlantis")
    codes = F.create_map(*[F.lit(x) for kv in fixed.STATES.items() for x in kv])
    return v.table("part").select(F.col("p_partkey").alias("id"), F.try_element_at(codes, F.upper(state)).alias("state"))


@query("SELECT company_id, website LIKE 'https://company%' AS site, linkedin_url IS NOT NULL AS company_page FROM companies WHERE website <> ''")
def url02_valid_urls(v: Views) -> DataFrame:
    rows = v.companies.where("website <> ''")
    return rows.select("company_id", urls.is_website(F.col("website")).alias("site"), urls.is_company_page(F.col("linkedin_url")).alias("company_page"))
