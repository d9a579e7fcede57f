"""Tests of funds' pages, feeds, releases, job posts and names, over landed rows that meet every branch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import pages
from ledgerloom.plans.registry import query, words_sql
from ledgerloom.plans.views import Views


def varied(key: str, values: list[str | None]):
    """One of several values by a key, as a function that gives the column, and in SQL."""
    quoted = ["NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in values]

    def column():
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.expr(key), F.lit(len(values))) + 1).cast("int"))

    return column, f"(CASE ({key}) % {len(values)} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(quoted)) + " END)"


_NEG, _NEG_SQL = varied("id", ["GV Ticker falls", "news of Electronics", "electronicsfair", "Peak XV leads", "peak xvi", "BVP Forge buys", "Thrive Market", "nothing"])
_SLUG, _SLUG_SQL = varied("id % 35 % 5", ["gv", "benchmark", "sequoia", "bessemer", "thrive"])


@query(f"""SELECT id, CASE {_SLUG_SQL} WHEN 'gv' THEN regexp_matches(t, '(^|[^\\pL\\pN_])(visionary holdings|gv ticker|nyse:gv)($|[^\\pL\\pN_])') WHEN 'benchmark' THEN regexp_matches(t, '(^|[^\\pL\\pN_])(international|electronics|benchmark capital management)($|[^\\pL\\pN_])')
WHEN 'sequoia' THEN regexp_matches(t, '(^|[^\\pL\\pN_])(hongshan|peak xv|sequoia india|sequoia china)($|[^\\pL\\pN_])') WHEN 'bessemer' THEN regexp_matches(t, '(^|[^\\pL\\pN_])bvp forge($|[^\\pL\\pN_])') ELSE regexp_matches(t, '(^|[^\\pL\\pN_])(thrive it services|thrive global|thrive market)($|[^\\pL\\pN_])') END AS negative,
CASE {_SLUG_SQL} WHEN 'gv' THEN contains(t, 'gv ticker') WHEN 'benchmark' THEN contains(t, 'electronics') WHEN 'sequoia' THEN contains(t, 'peak xv') WHEN 'bessemer' THEN contains(t, 'bvp forge') ELSE contains(t, 'thrive market') END AS negative_part
FROM (SELECT id, lower({_NEG_SQL} || ' ' || body) AS t FROM landed_rows)""")
def pre19_negative_keywords(v: Views) -> DataFrame:
    title = _NEG()
    return v.landed_rows.select("id", pages.negative(_SLUG(), title, F.col("body")).alias("negative"), pages.negative_part(_SLUG(), F.concat_ws(" ", title, "body")).alias("negative_part"))


_ITEM, _ITEM_SQL = varied("id", ["Thrive Wellness opens", "NFL first round pick", "Benchmark mineral prices", "gv STOCK", "Redpoint Bio files", "Arianna Huffington", "plain news"])
_NSLUG, _NSLUG_SQL = varied("id % 30 % 6", ["thrive", "first_round", "benchmark", "gv", "redpoint", "khosla"])


@query(f"""SELECT id, CASE {_NSLUG_SQL} WHEN 'thrive' THEN contains(t, 'thrive wellness') OR contains(t, 'arianna huffington') WHEN 'first_round' THEN contains(t, 'first round pick') OR contains(t, 'nfl') OR contains(t, 'nba') WHEN 'benchmark' THEN contains(t, 'benchmark mineral')
WHEN 'gv' THEN contains(t, 'gv stock') WHEN 'redpoint' THEN contains(t, 'redpoint bio') ELSE false END AS excluded FROM (SELECT id, lower({_ITEM_SQL} || ' ' || body) AS t FROM landed_rows)""")
def pre25_news_excludes(v: Views) -> DataFrame:
    return v.landed_rows.select("id", pages.news_excluded(_NSLUG(), F.concat_ws(" ", _ITEM(), "body")).alias("excluded"))


_FEED, _FEED_SQL = varied("id", ["techcrunch", "axios_prorata", "crunchbase_news", "fortune_term_sheet", "strictlyvc", "tech_funding_news", "venturebeat", "ventureburn", "hackernews", "other"])
_HEAD, _HEAD_SQL = varied("id % 221 % 13", ["Acme raises", "An exclusive", "It lands", "It bags", "It hits", "Deal done", "Y Combinator day", "Best crypto exchange for a round", "Genai tools", "B2B cloud", "Series of talks", "scoop", "zzz"])
_BASE = ["raises", "raised", "funding", "seed", "million", "billion", "led by", "investment", "round", "valuation", "venture", "capital"]
_ABCD = ["series a", "series b", "series c", "series d"]
_FEED_WORDS_SQL = {
    "techcrunch": [*_BASE, *_ABCD], "axios_prorata": [*_BASE, *_ABCD, "secures", "closes", "announces", "backs", "invests", "deal", "exclusive", "scoop"],
    "crunchbase_news": [*_BASE, *_ABCD, "secures", "closes", "announces", "backs", "invests"], "fortune_term_sheet": [*_BASE, "series", "deal", "closes", "closed", "secures", "secured", "lands"],
    "strictlyvc": [*_BASE, *_ABCD, "secures", "closes", "announces", "backs", "invests", "deal", "exclusive"], "tech_funding_news": [*_BASE, "series", "secures", "bags", "snaps", "hits", "closes", "announces"],
    "venturebeat": [*_BASE, *_ABCD, "secures", "closes", "announces", "backs", "invests"], "hackernews": [*_BASE, "series", "yc", "y combinator"],
}
_TAGS = ["saas", "b2b", "enterprise", "ai", "infrastructure", "devops", "security", "cybersecurity", "fintech", "healthtech", "devtools", "platform", "api", "cloud", "automation", "agent", "llm"]


@query(f"""SELECT id, CASE feed WHEN 'ventureburn' THEN NOT contains(t, 'best crypto exchange') AND {words_sql('t', [*_BASE, 'series', 'secures', 'closes', 'bags', 'snaps'])} {' '.join(f"WHEN '{f}' THEN {words_sql('t', w)}" for f, w in _FEED_WORDS_SQL.items())} END AS funding,
feed IN ('tech_funding_news', 'axios_prorata', 'crunchbase_news', 'strictlyvc', 'venturebeat') AND ({words_sql('t', _TAGS)} OR feed = 'venturebeat' AND {words_sql('t', ['genai', 'generative ai', 'machine learning', 'deep learning'])}) AS enterprise_ai
FROM (SELECT id, {_FEED_SQL} AS feed, lower({_HEAD_SQL} || ' ' || substr(body, 1, 30)) AS t FROM landed_rows)""")
def pre26_each_feed(v: Views) -> DataFrame:
    """Every feed by its own words, and the tag of enterprise AI (PRE-28)."""
    body = F.substring("body", 1, 30)
    return v.landed_rows.select("id", pages.feed_funding(_FEED(), _HEAD(), body).alias("funding"), pages.feed_enterprise_ai(_FEED(), _HEAD(), body).alias("enterprise_ai"))


_WIRE, _WIRE_SQL = varied("id", ["Ventures Index backs it", "given a16zed", "GV invests", "gvt", "Bill Gurley says", "Gurley Bill says", "Union Square opens", "square union", "usv", "bessemers", "none of them"])


@query(f"SELECT id, {_WIRE_SQL} IN ('Ventures Index backs it', 'GV invests', 'Bill Gurley says', 'Gurley Bill says', 'Union Square opens', 'square union', 'usv', 'bessemers') AS tracked FROM landed_rows")
def pre29_wire_names(v: Views) -> DataFrame:
    return v.landed_rows.select("id", pages.wire_names_fund(_WIRE(), F.lit("- ")).alias("tracked"))


_JOB, _JOB_SQL = varied("id", ["Amazon raises prices", "Why how Google works", "Acme's apple's day", "Pinecone raised $4M", "The Meta will", "about metals", "New startup at work", "Hiring: DevOps", "dellirium is here"])


@query(f"""SELECT id, {_JOB_SQL} IN ('Amazon raises prices', 'Why how Google works', 'Acme''s apple''s day', 'The Meta will', 'dellirium is here') OR {_JOB_SQL} = 'about metals' AS established, {words_sql('t', ['raises', 'raised', 'new startup', 'seed round', 'series a', 'backed by', 'led by'])} AS startup
FROM (SELECT id, lower({_JOB_SQL}) AS t FROM landed_rows)""")
def pre34_job_companies(v: Views) -> DataFrame:
    return v.landed_rows.select("id", pages.established_company(_JOB(), F.lit("")).alias("established"), pages.startup_signs(_JOB(), F.lit("")).alias("startup"))


_TOOL, _TOOL_SQL = varied("id", ["acme/rags", "some kv", "a kubernetes thing", "dusty", "Copilot for B2B", "workflow shop", "spin"])


@query(f"SELECT id, {_TOOL_SQL} IN ('acme/rags', 'a kubernetes thing') AS devtool, {_TOOL_SQL} IN ('Copilot for B2B', 'workflow shop') AS enterprise FROM landed_rows")
def pre35_tools(v: Views) -> DataFrame:
    return v.landed_rows.select("id", pages.devtool(_TOOL(), F.lit("")).alias("devtool"), pages.batch_enterprise(_TOOL(), F.lit(None).cast("string"), F.lit("")).alias("enterprise"))


_SAID = ["We double down on html", "Incubated in our studio", "Proud to announce: ml for all", "Congrats to BVP Forge", "We're leading the round", "usv led it", "Introducing Acme, an LLM shop", "quiet", "union square ventures is leading"]
_FLAG, _FLAG_SQL = varied("id", _SAID)


@query(f"""SELECT id, k = 0 AS follow_on, k = 1 AS incubated, k = 2 AS welcomed, k IN (2, 6) AS ai_focused, k = 3 AS forge, k IN (4, 5, 8) AS leads, k IN (3, 6) AS investment_title FROM (SELECT id, id % 9 AS k FROM landed_rows)""")
def pre36_page_flags(v: Views) -> DataFrame:
    return v.landed_rows.select("id", *[c.alias(n) for n, c in pages.page_flags(_FLAG(), _FLAG()).items()])


_PLACE, _PLACE_SQL = varied("id", ["Palo Alto and London", "London, Europe", "Mumbai and Delhi, India; New York", "nowhere", "Boston", "an indiana duke", "from the UK to Delhi"])


@query(f"SELECT id, CASE id % 7 WHEN 0 THEN 'us' WHEN 1 THEN 'london' WHEN 2 THEN 'india' WHEN 4 THEN 'us' WHEN 5 THEN 'india' WHEN 6 THEN 'london' END AS region FROM (SELECT id, {_PLACE_SQL} AS p FROM landed_rows)")
def pre37_regions(v: Views) -> DataFrame:
    """The region with most words; from the UK to Delhi is a tie, which the first wins."""
    return v.landed_rows.select("id", pages.region(_PLACE(), F.lit("")).alias("region"))


_NAME, _NAME_SQL = varied("id", ["Block (Square)", "Nova", " Stripe", "Xylo", "Acme", None, "<UNKNOWN>", "Unnamed Patent AI Startup", "A New Thing", "n/a", "Startup", "The Company", "the company we keep", "Stealth Co", ""])


@query(f"""SELECT id, coalesce(regexp_matches(trim(lower(n)), '^(block|stripe|x|unity|snap)'), false) AS well_known, coalesce(trim(lower(n)), '') IN ('<unknown>', 'unknown', 'n/a', 'none', 'tbd', '') AS no_name,
coalesce(n, '') <> '' AND (trim(lower(n)) IN ('<unknown>', 'unknown', 'n/a', 'none', 'tbd', '') OR regexp_matches(trim(lower(n)), '^unnamed\\s+|\\s+startup$|^the\\s+company$|^a\\s+new\\s+|^stealth\\s+')) AS made_up FROM (SELECT id, {_NAME_SQL} AS n FROM landed_rows)""")
def pre40_company_names(v: Views) -> DataFrame:
    """Well-known companies (PRE-40), names that are none and made-up ones (PRE-41)."""
    return v.landed_rows.select("id", pages.well_known(_NAME()).alias("well_known"), pages.no_company_name(_NAME()).alias("no_name"), pages.made_up_name(_NAME()).alias("made_up"))


_VERT, _VERT_SQL = varied("id", ["crypto", "games", "saas", "biotech"])


@query(f"SELECT id, {_VERT_SQL} IN ('crypto', 'games') OR {words_sql('lower(title)', ['crypto', 'web3', 'bio', 'games', 'gaming', 'consumer', 'nft', 'defi'])} AS excluded FROM landed_rows")
def apx02_verticals(v: Views) -> DataFrame:
    return v.landed_rows.select("id", pages.other_vertical(F.col("title"), F.array(_VERT(), F.lit("x"))).alias("excluded"))


@query(f"SELECT company_id, coalesce(regexp_extract(t, '(?i)investment\\s+in\\s+([A-Z][A-Za-z0-9\\s]+?)(?:\\s*[-:!]|\\s*$)', 1), '') AS company FROM (SELECT company_id, {varied('company_id', ['Our Investment in Acme Corp!', 'Investment in Zeta - why', 'No news'])[1]} AS t FROM companies)")
def pre39_title_companies(v: Views) -> DataFrame:
    title = varied("company_id", ["Our Investment in Acme Corp!", "Investment in Zeta - why", "No news"])[0]()
    return v.companies.select("company_id", F.coalesce(pages.company_of_title(title), F.lit("")).alias("company"))
