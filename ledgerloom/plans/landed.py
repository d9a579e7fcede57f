"""Landed pages, feeds and answers as rows, and what enrichment makes of search results: cases with their results."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scoring
from ledgerloom.operators import enrich
from ledgerloom.plans.predicates import varied
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import AS_OF, Views
from ledgerloom.sources import landed, markup

_NOW = datetime.datetime(2026, 1, 31, 12)
_TODAY = _NOW.date()


def per_row(values: list[str | None]):
    """One of several documents by id."""
    return varied("id", values)[0]()


def _by(n: int, *values: str) -> str:
    return f"(CASE id % {n} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(values)) + " END)"


_CARDS = """<html><body><div class="other"><article><h2>First long title here</h2><a href="/one">read</a><time datetime="2025-12-18">Dec</time><span class="tag">AI</span></article>
<article><h3>Short</h3><a href="/two">x</a></article><div class="news-item big"><a href="https://bvp.com/three">A title that is the link</a></div></div><article><h2>First again, another title</h2><a href="/one">x</a></article></body></html>"""
_WRAPPED = """<a href="https://a16z.com/x"><article><p class="my-title">Wrapped in an address</p></article></a><article><h2>Elsewhere than at home</h2><a href="https://b.com/y">z</a></article>"""


@query("""SELECT id, fund, title, url, published_date, tags FROM (SELECT id, 'bessemer' AS fund, unnest(['First long title here', 'A title that is the link']) AS title, unnest(['https://bvp.com/one', 'https://bvp.com/three']) AS url, unnest([DATE '2025-12-18', NULL]) AS published_date, unnest(['ai', '']) AS tags FROM landed_rows WHERE id % 3 = 0)
UNION ALL SELECT id, 'a16z', 'Wrapped in an address', 'https://a16z.com/x', NULL, '' FROM landed_rows WHERE id % 3 = 1""")
def src04_fund_lists(v: Views) -> DataFrame:
    """Items of funds' list pages (APX-01); pages of funds that never announce anything give none (APX-04)."""
    raw = v.landed_rows.select("id", per_row(["bessemer", "a16z", "khosla"]).alias("fund"), per_row([_CARDS, _WRAPPED, _CARDS]).alias("html"))
    lists = landed.fund_lists(raw.select("fund", "html").distinct())
    return raw.select("id", "fund").join(lists, "fund").select("id", "fund", "title", "url", "published_date", F.array_join("tags", ",").alias("tags"))


@query("SELECT id, id % 3 = 0 AS kept FROM landed_rows WHERE id % 3 <> 2")
def src01_fund_articles(v: Views) -> DataFrame:
    """Pages that a fund's negative keywords leave, as text (SRC-02); the page of each third row isn't left."""
    raw = v.landed_rows.select("id", F.lit("gv").alias("fund"), F.lit("News").alias("title"), F.lit("u").alias("url"), per_row(["<p>All well</p>", "<p>gv tickers</p>", "<p>GV Ticker</p>"]).alias("html"))
    return landed.articles(raw).select("id", (F.col("text") == "All well").alias("kept"))


_REPOS = """<article class="Box-row"><h2><a href="/acme/tool"> acme /
 tool</a></h2><p>A tool</p><span itemprop="programmingLanguage">Rust</span><a class="Link--muted" href="/acme/tool/stargazers">12,345</a><a class="Link--muted" href="/acme/tool/forks">1,002</a>
<img class="avatar" alt="@jane"><span class="float-sm-right">1,250 stars today</span></article><article class="Box-row"><h2><a href=" ">none</a></h2></article><article class="Box-row"><h2><a href="/b/c">b/c</a></h2></article>"""


@query("SELECT id, unnest(['acme/tool', 'b/c']) AS name, unnest(['https://github.com/acme/tool', 'https://github.com/b/c']) AS url, unnest(['Rust', NULL]) AS language, unnest([1250, 0]) AS stars_today, unnest([12345, 0]) AS total_stars, unnest([1002, 0]) AS forks, unnest(['jane', '']) AS built_by FROM landed_rows WHERE id % 2 = 0")
def src10_trending(v: Views) -> DataFrame:
    rows = v.landed_rows.select("id", F.explode(markup.repositories(per_row([_REPOS, None]))).alias("r")).select("id", "r.*")
    return rows.select("id", "name", "url", "language", "stars_today", "total_stars", "forks", F.array_join("built_by", ",").alias("built_by"))


_COMPANIES = '<div class="company"><h3> Nova </h3></div><div class="company"><h3>nova</h3></div><div class="company"><h3>X</h3></div><div class="company"><h3>Zed Labs</h3></div>'


@query("SELECT id, 'Nova,Zed Labs' AS names FROM landed_rows WHERE id % 2 = 0 UNION ALL SELECT id, 'Logo' FROM landed_rows WHERE id % 2 = 1")
def apx12_portfolios(v: Views) -> DataFrame:
    k, html = F.col("id") % 2, per_row([_COMPANIES, '<a class="company"><img alt="Logo"></a>'])
    names = F.when(k == 0, markup.portfolio(html, ".none, .company", "h3, h4")).otherwise(markup.portfolio(html, ".company", "img", "alt"))
    return v.landed_rows.select("id", F.array_join(names, ",").alias("names"))


def _hits(rows: list[dict], key: str = "hits") -> str:
    return json.dumps({key: rows})


_AT = 1_769_800_000  # 2026-01-30 19:06:40


@query(f"SELECT CAST(id % 40 AS VARCHAR) AS story_id, 'Story ' || CAST(min(id) AS VARCHAR) AS title, CAST(max(0) AS BIGINT) + arg_min(score, id) AS score FROM landed_rows WHERE id % 6 <> 5 AND id % 11 <> 10 GROUP BY 1")
def src08_stories(v: Views) -> DataFrame:
    """Posts of search answers since a cutoff, each once; some are old, some have no title."""
    k = F.col("id")
    hit = F.struct(
        (k % 40).cast("string").alias("objectID"), F.when(k % 11 != 10, F.concat(F.lit("Story "), k.cast("string"))).alias("title"), F.col("score").alias("points"), F.when(k % 6 == 5, F.lit(_AT - 900_000)).otherwise(F.lit(_AT)).alias("created_at_i")
    )
    answers = v.landed_rows.select(k.alias("rank"), F.to_json(F.struct(F.array(hit).alias("hits"))).alias("answer"))
    return landed.stories(answers, _NOW).select("story_id", "title", "score")


@query("SELECT 'Co ' || CAST(id % 60 AS VARCHAR) AS name, 'https://www.ycombinator.com/companies/c' || CAST(min(id) AS VARCHAR) AS url, CASE WHEN min(id) % 2 = 0 THEN 'B2B, AI' ELSE '' END AS industry FROM landed_rows WHERE id % 12 < 10 AND id % 7 <> 3 GROUP BY 1")
def src09_batches(v: Views) -> DataFrame:
    """Companies of index pages, up to ten a batch, each name once (APX-13); some have no address."""
    k = F.col("id")
    hit = F.struct(F.concat(F.lit(" Co "), (k % 60).cast("string")).alias("name"), F.when(k % 7 != 3, F.concat(F.lit("c"), k.cast("string"))).alias("slug"), F.when(k % 2 == 0, F.array(F.lit("B2B"), F.lit(None), F.lit("AI"))).alias("industries"))
    answers = v.landed_rows.select(k.alias("batch_rank"), (k % 12).alias("page"), F.to_json(F.struct(F.array(hit).alias("hits"))).alias("answer"))
    return landed.batch_companies(answers).select("name", "url", "industry")


_TITLES = ["D - Acme Robotics (0001)", "D/A - Beta, Inc. (0002)", "10-K - Gamma (3)", "D - Delta Fund II (0004)"]


@query("""SELECT seq, form_type, company_name, cik, filing_date FROM (SELECT id AS seq, CASE id % 4 WHEN 1 THEN 'D/A' ELSE 'D' END AS form_type, CASE id % 4 WHEN 0 THEN 'Acme Robotics' WHEN 1 THEN 'Beta, Inc.' ELSE 'Delta Fund II' END AS company_name, CASE id % 4 WHEN 0 THEN '0001' WHEN 1 THEN '0002' ELSE '0004' END AS cik,
CASE id % 3 WHEN 0 THEN DATE '2026-01-20' WHEN 1 THEN DATE '2026-01-19' ELSE DATE '2026-01-01' END AS filing_date FROM (SELECT * FROM landed_rows ORDER BY id LIMIT 100) WHERE id % 4 <> 2 AND id % 5 <> 4)""")
def src11_filings_of_feed(v: Views) -> DataFrame:
    """The first hundred entries of a feed (APX-10), dates from three places, old ones left out."""
    k = F.col("id")
    entries = v.landed_rows.select(
        k.alias("seq"), per_row(_TITLES).alias("title"), F.when(k % 5 == 4, "2020-01-01").when(k % 3 == 0, "2026-01-20T10:00:00-05:00").otherwise("soon").alias("updated"), F.when(k % 3 == 1, "2026-01-19").alias("published"),
        F.lit("https://sec.gov/Archives/edgar/data/1/0001234567-26-000123/x").alias("link"),
    )
    return landed.filings_of_feed(entries, datetime.date(2026, 1, 1)).select("seq", "form_type", "company_name", "cik", "filing_date")


_XML = """<edgarSubmission><primaryIssuer><jurisdictionOfInc>Delaware</jurisdictionOfInc></primaryIssuer><relatedPersonsList><relatedPersonInfo><relatedPersonName><firstName>Jane</firstName><lastName>Doe</lastName></relatedPersonName></relatedPersonInfo>
<relatedPersonInfo><relatedPersonName><firstName>Jane</firstName><lastName>Doe</lastName></relatedPersonName></relatedPersonInfo></relatedPersonsList><offeringData><industryGroup><industryGroupType>Other Technology</industryGroupType></industryGroup>
<offeringSalesAmounts><totalOfferingAmount>Indefinite</totalOfferingAmount><totalAmountSold>2500000.75</totalAmountSold></offeringSalesAmounts></offeringData></edgarSubmission>"""
_AMENDED = "<edgarSubmission><primaryIssuer><issuerStateOrCountry>ca</issuerStateOrCountry></primaryIssuer><offeringData><typeOfFiling><newOrAmendment><isAmendment>true</isAmendment></newOrAmendment></typeOfFiling><offeringSalesAmounts><totalOfferingAmount>750000</totalOfferingAmount></offeringSalesAmounts></offeringData></edgarSubmission>"


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN '$2,500,000' END AS amount_raised, CASE WHEN id % 4 = 1 THEN '$750,000' END AS total_offering, CASE WHEN id % 4 = 0 THEN 'Jane Doe' ELSE '' END AS investors, id % 4 = 0 AS is_first_sale, CASE WHEN id % 4 = 0 THEN 'Other Technology' END AS industry, CASE WHEN id % 4 = 0 THEN 'DE' ELSE 'CA' END AS state
FROM landed_rows WHERE id % 4 < 2""")
def src12_filing_details(v: Views) -> DataFrame:
    rows = v.landed_rows.select("id", F.lit("D").alias("form_type"), per_row([_XML, _AMENDED, None, "<edgarSubmission><broken"]).alias("xml"))
    return landed.filing_details(rows).select("id", "amount_raised", "total_offering", F.array_join("investors", ",").alias("investors"), "is_first_sale", "industry", "state")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_id) AS n, nullif(coalesce(nullif(amount_raised, ''), total_offering), '') AS money FROM landed_filings), s AS (SELECT filing_id, CASE WHEN starts_with(company_name, 'Orbit') AND filing_id % 3 = 0 THEN 'fund_matched'
WHEN industry IN ('Technology', 'Other Health Care') AND (is_first_sale OR coalesce(TRY_CAST(replace(replace(money, '$', ''), ',', '') AS BIGINT), 0) >= 500000) THEN 'likely_vc' END AS kind FROM f WHERE n = 1 AND NOT contains(company_name, 'SPV') AND company_name <> 'Beta Fund II') SELECT filing_id, kind FROM s WHERE kind IS NOT NULL""")
def sco10_selected_filings(v: Views) -> DataFrame:
    """The first filing of each filer: those with a tracked fund among their people, then those likely backed."""
    person = F.when(F.col("company_name").startswith("Orbit") & (F.col("filing_id") % 3 == 0), "Accel Partners").otherwise("Nobody")
    rows = v.landed_filings.withColumn("seq", F.col("filing_id")).withColumn("investors", F.array(person))
    return landed.selected_filings(rows.drop("fund")).select("filing_id", "kind")


@query("""SELECT r.id, k.rank, 'https://x.y/' || CAST(k.rank AS VARCHAR) AS url, DATE '2026-01-31' - CASE k.rank WHEN 0 THEN 3 WHEN 1 THEN 14 ELSE 0 END AS day FROM landed_rows r CROSS JOIN (VALUES (0), (1), (3)) k(rank)""")
def src16_search_results(v: Views) -> DataFrame:
    """Results of a search, at most four, with dates from their ages; the third has no title."""
    ages = ["3 days ago", "2 weeks ago", "1 day ago", "5 hours ago", "1 day ago"]
    answer = _hits([{"url": f"https://x.y/{k}", "title": "" if k == 2 else "T", "age": a} for k, a in enumerate(ages)], "results")
    return landed.search_results(v.landed_rows.select(F.col("id").alias("search_id"), F.lit(answer).alias("answer")), _TODAY, 4).select(F.col("search_id").alias("id"), F.col("rank").cast("int").alias("rank"), "url", "day")


_KINDS = ["partner", "fund", "early", "stealth", "enterprise", "regional"]


@query(f"""WITH r AS (SELECT id, 'https://x.y/' || CAST(id % 37 AS VARCHAR) AS url, {_by(6, *[f"'{k}'" for k in _KINDS])} AS kind FROM landed_rows) SELECT url, arg_min('fund_' || CAST(id AS VARCHAR), CASE kind WHEN 'fund' THEN 1 WHEN 'enterprise' THEN 2 WHEN 'stealth' THEN 3 WHEN 'regional' THEN 4 WHEN 'early' THEN 5 ELSE 6 END * CAST(1000000000 AS BIGINT) + id) AS fund, string_agg(DISTINCT kind, ',' ORDER BY kind) AS tags FROM r GROUP BY url""")
def apx09_merged_searches(v: Views) -> DataFrame:
    rows = v.landed_rows.select(F.concat(F.lit("https://x.y/"), (F.col("id") % 37).cast("string")).alias("url"), per_row(_KINDS).alias("kind"), F.col("id").alias("search_id"), F.lit(0).alias("rank"), F.concat(F.lit("fund_"), F.col("id").cast("string")).alias("fund"), "title")
    return landed.merged_searches(rows).select("url", "fund", "tags")


@query(f"""WITH i AS (SELECT id AS seq, 'u' || CAST(id % 50 AS VARCHAR) AS url, 'Head - line ' || CAST(id % 30 AS VARCHAR) AS title, CASE WHEN id % 4 = 0 THEN NULL ELSE 'Paper' END AS source FROM landed_rows WHERE day IS NULL OR day >= DATE '{AS_OF}' - 60), u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS n FROM i),
t AS (SELECT *, row_number() OVER (PARTITION BY lower(title || CASE WHEN source IS NULL THEN 'x' ELSE '' END) ORDER BY seq) AS m FROM u WHERE n = 1) SELECT seq, CASE WHEN source IS NULL THEN 'Head' ELSE title END AS title, coalesce(source, replace(title, 'Head - ', '')) AS source FROM t WHERE m = 1 AND source IS NOT NULL
UNION ALL SELECT min(seq), 'Head', arg_min(replace(title, 'Head - ', ''), seq) FROM t WHERE source IS NULL AND n = 1""")
def apx08_news_items(v: Views) -> DataFrame:
    """Search news, each address and each title once; what stands after the last hyphen is the source."""
    k = F.col("id")
    head = F.concat(F.lit("Head - line "), (k % 30).cast("string"), F.when(k % 4 == 0, "").otherwise(" - Paper"))
    rows = v.landed_rows.select(k.alias("seq"), F.concat(F.lit("u"), (k % 50).cast("string")).alias("url"), head.alias("headline"), "day")
    return landed.news_items(rows, AS_OF - datetime.timedelta(days=60)).select("seq", "title", "source")


@query("SELECT CAST(id % 45 AS VARCHAR) AS id, min(id) AS rank FROM landed_rows WHERE id % 2 = 0 AND id % 3 <> 2 GROUP BY 1")
def src18_tweets(v: Views) -> DataFrame:
    """Tweets about funding since a cutoff, each id once (APX-14)."""
    k = F.col("id")
    t = F.struct((k % 45).cast("string").alias("id"), F.when(k % 2 == 0, "Acme raised a round").otherwise("Acme raised chickens").alias("text"), F.when(k % 3 == 2, "2026-01-01T00:00:00Z").otherwise("2026-01-31T00:00:00Z").alias("created_at"))
    return landed.tweets(v.landed_rows.select(k.alias("rank"), F.to_json(F.struct(F.array(t).alias("data"))).alias("answer")), _NOW, 48).select("id", "rank")


_SCORED = ["hackernews", "ycombinator", "github_trending", "linkedin", "delaware", "elsewhere"]


@query(f"""WITH s AS (SELECT article_id, title, CASE article_id % 6 WHEN 0 THEN 'hackernews' WHEN 1 THEN 'ycombinator' WHEN 2 THEN 'github' WHEN 3 THEN 'linkedin' WHEN 4 THEN 'delaware' END AS kind FROM articles) SELECT kind, count(*) AS n FROM s WHERE kind IS NOT NULL GROUP BY kind""")
def sco06_dispatched(v: Views) -> DataFrame:
    """Every source by its own score; unknown sources have none."""
    source = varied("article_id", _SCORED)[0]()
    kind, score = scoring.dispatched(source, F.col("title"), F.col("text"), F.lit(None).cast("array<string>"))
    return v.articles.select(kind.alias("kind"), score.alias("score")).where("score IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT CAST(id % 25 AS VARCHAR) AS company_name, CAST(max(40 + CASE WHEN id % 3 = 0 THEN 10 ELSE 0 END) AS INTEGER) AS score FROM landed_rows WHERE id % 4 <> 3 GROUP BY 1")
def sco06_kept_signals(v: Views) -> DataFrame:
    """Signals of 25 points or more, the best of each company."""
    title = F.concat(F.lit("Co "), F.when(F.col("id") % 3 == 0, " (YC W24)").otherwise(""))
    source = F.when(F.col("id") % 4 == 3, "github").otherwise("ycombinator")
    _, score = scoring.dispatched(source, title, F.lit("zz"), F.lit(None).cast("array<string>"))
    return v.landed_rows.select((F.col("id") % 25).cast("string").alias("company_name"), score.alias("score")).where("score >= 25").groupBy("company_name").agg(F.max("score").alias("score"))


@query("SELECT company_id, lpad(CAST(company_id * 10 + 1 AS VARCHAR), 10, '0') AS cik FROM companies WHERE company_id % 4 <> 3")
def enr03_filers(v: Views) -> DataFrame:
    """The filer whose name is a company's own; one that comes eleventh isn't read."""
    ranks = v.companies.select("company_id", "name", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("j"))
    name = F.when(F.col("j") == 1, F.upper("name")).otherwise(F.lit("Zq Xw Vv 0000000000000000000000"))
    rank = F.when((F.col("j") == 1) & (F.col("company_id") % 4 == 3), 11).otherwise(F.col("j") + 1)
    found = ranks.select("company_id", rank.alias("rank"), name.alias("sec_name"), (F.col("company_id") * 10 + F.col("j")).cast("string").alias("cik"))
    return enrich.filers(v.companies, found).select("company_id", "cik")


@query("SELECT CAST(id AS VARCHAR) AS cik, form, filed, 'https://www.sec.gov/Archives/edgar/data/' || CAST(id AS VARCHAR) || '/' || acc || '/primary_doc.xml' AS url FROM landed_rows CROSS JOIN (VALUES ('D', DATE '2026-01-02', '000126000001'), ('D/A', DATE '2025-03-01', '')) f(form, filed, acc)")
def enr04_recent_filings(v: Views) -> DataFrame:
    forms, filed, accessions = ["10-K", "D", "D", "D", "D/A"], ["2026-01-01", "2026-01-02", "2024-01-01", "soon", "2025-03-01"], ["x", "0001-26-000001", "y", "z"]
    arr = lambda xs: F.array(*map(F.lit, xs))
    rows = v.landed_rows.select(F.col("id").cast("string").alias("cik"), arr(forms).alias("forms"), arr(filed).alias("filed"), arr(accessions).alias("accessions"))
    return enrich.recent_filings(rows, _TODAY)


_FOUND = [("Acme raises", "no date", "3 days ago"), ("Acme raises", "on Dec 15, 2025", ""), ("Acme, Jan 5, 2026", "nothing", "soon"), ("Other raises", "on Dec 15, 2025", "1 day ago"), ("Acme", "in 2019-01-01", None)]


@query("""SELECT id AS deal_id, CASE id % 5 WHEN 0 THEN DATE '2026-01-28' WHEN 1 THEN DATE '2025-12-15' WHEN 2 THEN DATE '2026-01-05' ELSE DATE '2025-11-01' END AS found_date, CASE id % 5 WHEN 0 THEN 'page_age' WHEN 2 THEN 'title' ELSE 'snippet' END AS date_source, CASE id % 5 WHEN 0 THEN 'high' WHEN 2 THEN 'low' ELSE 'medium' END AS confidence FROM landed_rows""")
def enr05_announced(v: Views) -> DataFrame:
    """Dates of the first search result that names a company and has one; the second query has a date in every case."""
    deals = v.landed_rows.select(F.col("id").alias("deal_id"), F.lit("Acme Robotics").alias("name"))
    one = v.landed_rows.select(F.col("id").alias("deal_id"), F.lit(0).alias("query"), F.lit(0).alias("rank"), *[varied("id", [f[j] for f in _FOUND])[0]().alias(c) for j, c in enumerate(("title", "description", "page_age"))])
    two = v.landed_rows.select(F.col("id").alias("deal_id"), F.lit(1).alias("query"), F.lit(0).alias("rank"), F.lit("acme robotics").alias("title"), F.lit("2025-11-01").alias("description"), F.lit("").alias("page_age"))
    return enrich.announced(deals, one.unionByName(two), _TODAY)


@query("SELECT id AS company_id, CASE WHEN id % 2 = 0 THEN 'https://acme.io' ELSE 'https://getacme.com' END AS website FROM landed_rows")
def enr09_websites(v: Views) -> DataFrame:
    """The first result that may be a company's own site (APX-20: queries stand one behind the other)."""
    companies = v.landed_rows.select(F.col("id").alias("company_id"), F.lit("Acme").alias("name"))
    urls = F.array(F.lit("https://linkedin.com/company/acme"), F.when(F.col("id") % 2 == 0, "https://acme.io").otherwise("https://acme.ru"), F.lit("https://getacme.com"))
    return enrich.websites(companies, v.landed_rows.select(F.col("id").alias("company_id"), F.posexplode(urls).alias("rank", "url")))


@query("""SELECT id AS company_id, CASE id % 4 WHEN 0 THEN 'https://linkedin.com/in/known' WHEN 1 THEN 'https://linkedin.com/in/jane-doe' WHEN 2 THEN 'https://linkedin.com/in/jane-ceo' END AS linkedin_url FROM landed_rows""")
def apx18_founders(v: Views) -> DataFrame:
    """A founder's known address, else a valid profile, else that of the chief executive if of that name."""
    k = F.col("id")
    known = v.landed_rows.select(k.alias("company_id"), F.lit("Acme").alias("company"), F.lit("Jane Doe").alias("founder"), F.when(k % 4 == 0, "https://linkedin.com/in/known").otherwise("").alias("linkedin_url"))
    asked = v.landed_rows.select(k.alias("company_id"), F.lit("Jane Doe").alias("founder"), F.lit(1).alias("rank"), F.when(k % 4 == 1, "Jane Doe - CEO at Acme | LinkedIn").otherwise("Jane Doe - Baker at Bakery").alias("title"), F.lit("").alias("description"), F.lit("https://linkedin.com/in/jane-doe").alias("url"))
    chief = v.landed_rows.select(k.alias("company_id"), F.lit(None).cast("string").alias("founder"), F.lit(1).alias("rank"), F.when(k % 4 == 2, "Jane M. Doe - CEO at Acme").otherwise("John Roe - CEO at Acme").alias("title"), F.lit("").alias("description"), F.lit("https://linkedin.com/in/jane-ceo").alias("url"))
    return enrich.founders(known, asked.unionByName(chief)).select("company_id", "linkedin_url")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'miss' WHEN id % 5 = 1 THEN 'nothing' WHEN id % 5 = 2 THEN 'miss' ELSE 'hit' END AS state FROM landed_rows")
def enr11_cached_lookups(v: Views) -> DataFrame:
    """Lookups that a cache answers, with or without a result; old entries don't count."""
    k = F.col("id")
    cache = v.landed_rows.where("id % 5 != 0").select(k.alias("key"), F.when(k % 5 != 1, "found").alias("value"), F.when(k % 5 == 2, F.lit(_NOW - datetime.timedelta(days=31))).otherwise(F.lit(_NOW)).alias("stored_at"))
    return enrich.looked_up(v.landed_rows.select(k.alias("key")), cache, _NOW).select(F.col("key").alias("id"), "state")


@query("""SELECT deal_id, CASE WHEN deal_id % 3 = 0 AND (announced_date IS NULL OR deal_id % 4 < 2) THEN DATE '2001-06-01' ELSE announced_date END AS announced_date FROM deals""")
def apx22_surer_dates(v: Views) -> DataFrame:
    """Deals' dates after a search: a surer date replaces one, any date fills a gap."""
    k = F.col("deal_id")
    found = v.deals.where("deal_id % 3 = 0").select("deal_id", F.lit(datetime.date(2001, 6, 1)).alias("found_date"), F.lit(0.8).alias("sure"))
    return enrich.surer_dates(v.deals.withColumn("date_confidence", F.when(k % 4 < 2, 0.5).otherwise(0.95)), found).select("deal_id", "announced_date")


@query("""SELECT deal_id, CASE WHEN deal_id % 4 = 0 THEN created_date + 1 ELSE announced_date END AS announced_date, CASE WHEN deal_id % 2 = 0 THEN created_date + 1 END AS sec_filing_date FROM deals""")
def apx21_filed_deals(v: Views) -> DataFrame:
    """Deals with their filing: always its date beside theirs, in place of theirs only if the match is confident."""
    matches = v.deals.where("deal_id % 2 = 0").select("deal_id", F.date_add("created_date", 1).alias("filed"), F.lit("u").alias("url"), (F.col("deal_id") % 4 == 0).alias("confident"))
    return enrich.with_filing(v.deals.withColumn("date_confidence", F.lit(0.5)), matches).select("deal_id", "announced_date", "sec_filing_date")
