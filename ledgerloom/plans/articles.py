"""Articles: pre-filters, classifiers and scores, over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import classify, fixed, names, scoring, text, urls
from ledgerloom.operators import prefilter
from ledgerloom.plans.registry import count_sql, list_sql, query, words_sql
from ledgerloom.plans.views import AS_OF, Views

_NORMAL_URL = f"""(lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') ||
CASE WHEN len(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN {list_sql(fixed.TRACKING_PARAMETERS)})) > 0
THEN '?' || array_to_string(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN {list_sql(fixed.TRACKING_PARAMETERS)}), '&') ELSE '' END)"""
_SQUEEZED = "trim(regexp_replace(text, '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\v]+', ' ', 'g'), ' ')"
_PRINT = f"md5(CASE WHEN length({_SQUEEZED}) < 700 THEN {_SQUEEZED} ELSE left({_SQUEEZED}, 500) || right({_SQUEEZED}, 200) END)"
_T, _X = "lower(title)", "lower(text)"
_B = "(lower(title) || ' ' || lower(text))"


def _pattern(words: list[str]) -> str:
    return "(" + "|".join("".join(f"[{c}]" if c in "$.()+*?|" else c for c in w) for w in words).replace("'", "''") + ")"


@query(f"SELECT page_id, {_NORMAL_URL} AS normal_url FROM pages")
def pre02_normal_urls(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", urls.normalised(F.col("url")).alias("normal_url"))


@query("SELECT article_id, source FROM (SELECT article_id, source, row_number() OVER (PARTITION BY source ORDER BY article_id) AS n FROM articles) WHERE n <= 100")
def pre01_cap_per_source(v: Views) -> DataFrame:
    return prefilter.cap_per_source(v.articles, 100).select("article_id", "source")


@query(f"SELECT {_NORMAL_URL} AS normal_url, min(article_id) AS article_id FROM articles GROUP BY 1")
def pre03_first_per_url(v: Views) -> DataFrame:
    return prefilter.first_per_url(v.articles).select("normal_url", "article_id")


@query(f"WITH stored AS (SELECT {_NORMAL_URL} AS url FROM articles WHERE article_id % 5 = 0) SELECT article_id FROM articles WHERE url NOT IN (SELECT url FROM stored) AND {_NORMAL_URL} NOT IN (SELECT url FROM stored)")
def pre04_unseen_urls(v: Views) -> DataFrame:
    stored = v.articles.where("article_id % 5 = 0").select(urls.normalised(F.col("url")).alias("url"))
    return prefilter.unseen(v.articles, stored).select("article_id")


_PAGES = [
    ("news", "https://www.crunchbase.com/lists/x", "Acme raises $5M", "source: crunchbase page"), ("crunchbase", "https://x.y/reviews/z", "Acme raises $5M", "source: crunchbase page"), ("crunchbase", "https://x.y/news", "Acme raises $5M", "keep"),
    ("ycombinator", "https://x.y/library/z", "Seed round", "source: yc page"), ("news", "https://ycombinator.com/companies/a", "How to apply", "source: yc title"), ("hackernews", "https://x.y", "Show HN: a database", "source: hn show"),
    ("hackernews", "https://x.y", "Show HN: we raise funding", "not funding"), ("news", "https://linkedin.com/learning/x", "Series A", "source: linkedin page"), ("news", "https://x.y", "2025 recap of series a", "title"),
    ("news", "https://x.y", "Big round for investor", "keep"), ("news", "https://x.y", "Funding", "not funding"), ("news", "https://x.y", None, "keep"),
]


@query(f"""SELECT article_id, CASE WHEN article_id % 2 = 1 THEN CASE article_id // 2 % {len(_PAGES)} {' '.join(f"WHEN {k} THEN '{p[-1]}'" for k, p in enumerate(_PAGES))} END WHEN {words_sql(_T, fixed.NO_ANNOUNCEMENT)} THEN 'title'
WHEN NOT ({words_sql(_T, fixed.STRONG_TITLE)} OR {count_sql(_T, fixed.WEAK_TITLE)} >= 2) THEN 'not funding' ELSE 'keep' END AS verdict FROM articles""")
def pre07_verdicts(v: Views) -> DataFrame:
    """Every other article is one of the pages that the rules of sources are about."""
    pick = lambda j: F.element_at(F.array(*[F.lit(p[j]) for p in _PAGES]), (F.floor(F.col("article_id") / 2) % len(_PAGES) + 1).cast("int"))
    odd = F.col("article_id") % 2 == 1
    rows = v.articles.withColumns({c: F.when(odd, pick(j)).otherwise(F.col(c)) for j, c in enumerate(("source", "url", "title"))})
    return prefilter.judged(rows).select("article_id", "verdict")


@query(f"SELECT doc_id, {_PRINT} AS fingerprint FROM documents")
def pre10_content_fingerprint(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", text.content_fingerprint(F.col("text")).alias("fingerprint"))


@query(f"SELECT doc_id, substr(sha256(lower({_SQUEEZED})), 1, 32) AS content_hash FROM documents")
def pre11_content_hash(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query(f"""WITH a AS (SELECT article_id, text, {_PRINT} AS h, length(text) AS n FROM articles), s AS (SELECT h, max(n // CASE WHEN article_id % 2 = 0 THEN 1 ELSE 3 END) AS n FROM a WHERE article_id % 4 = 0 AND article_id % 12 <> 0 GROUP BY h)
SELECT min(a.article_id) AS article_id, a.h AS content_hash FROM a LEFT JOIN s USING (h) WHERE s.h IS NULL OR a.n > greatest(100, 2 * s.n) GROUP BY a.h""")
def pre13_fresh_contents(v: Views) -> DataFrame:
    import datetime

    n = F.floor(F.length("text") / F.when(F.col("article_id") % 2 == 0, 1).otherwise(3)).cast("long")
    until = F.when(F.col("article_id") % 12 == 0, F.lit(AS_OF)).otherwise(F.lit(AS_OF + datetime.timedelta(days=30)))
    stored = v.articles.where("article_id % 4 = 0").select(text.content_fingerprint(F.col("text")).alias("content_hash"), n.alias("content_length"), until.alias("expires_on"))
    return prefilter.fresh_contents(v.articles, stored, AS_OF).select("article_id", "content_hash")


@query(f"""SELECT article_id, (s > 0 AND a > 0) OR s + a >= 3 AS funding FROM (SELECT article_id, len(regexp_extract_all({_X}, '{_pattern(fixed.STRONG_FUNDING)}')) AS s, len(regexp_extract_all({_X}, '{_pattern(fixed.AMOUNT_WORDS)}')) AS a FROM articles)""")
def pre17_funding_content(v: Views) -> DataFrame:
    return v.articles.select("article_id", text.likely_funding_content(F.col("text")).alias("funding"))


@query(f"SELECT article_id, {words_sql('lower(url)', fixed.CRYPTO_SITES)} AS crypto_site FROM articles")
def pre18_crypto_sites(v: Views) -> DataFrame:
    return v.articles.select("article_id", classify.crypto_site(F.col("url")).alias("crypto_site"))


_DESC = "lower('startup for ' || source)"
_AI = words_sql(_X, fixed.AI_IN_CRYPTO_TEXT)
_NAME = "lower(split_part(title, ' ', 1))"


def _name(v: Views):
    return F.element_at(F.split("title", " "), 1)


def _description():
    return F.concat(F.lit("startup for "), F.col("source"))


def _lowered(v: Views) -> DataFrame:
    """Articles with their text in lower case, once for all that read it."""
    return v.articles.withColumn("low", F.lower("text"))


@query(f"""SELECT article_id, CASE WHEN {words_sql(_NAME, fixed.KNOWN_CRYPTO)} THEN 'known' WHEN {words_sql(_NAME, fixed.CRYPTO_NAMES)} THEN 'name' WHEN regexp_matches({_NAME}, '\\bprotocol\\b|\\btoken\\b|\\bcoin\\b') THEN 'name word'
WHEN {words_sql(_DESC, fixed.CRYPTO_WORDS)} AND NOT {words_sql(_DESC, fixed.AI_IN_DESCRIPTION)} THEN 'description' WHEN len(regexp_extract_all({_X}, '{_pattern(fixed.CRYPTO_WORDS)}')) >= CASE WHEN {_AI} THEN 6 ELSE 4 END THEN 'density'
WHEN {words_sql(_X, fixed.CRYPTO_LABELS)} AND NOT {_AI} THEN 'label' END AS reason FROM articles""")
def cls01_crypto(v: Views) -> DataFrame:
    return _lowered(v).select("article_id", classify.crypto(_name(v), _description(), F.col("text"), F.lit(None).cast("string"), F.array(F.lit("Foo Capital")), F.col("low")).alias("reason"))


@query(f"""SELECT article_id, CASE WHEN {words_sql(_NAME, fixed.KNOWN_FINTECH)} THEN 'known' WHEN {words_sql(_NAME, fixed.FINTECH_NAMES)} AND {count_sql(_X, fixed.FINTECH_WORDS)} >= 2 AND NOT {words_sql(_X, fixed.AI_IN_FINTECH_TEXT)} THEN 'name'
WHEN {count_sql(_X, fixed.FINTECH_WORDS)} >= 3 AND NOT {words_sql(_X, fixed.AI_IN_FINTECH_TEXT)} THEN 'density' WHEN {words_sql(_DESC, fixed.FINTECH_DESCRIPTIONS)} THEN 'description' END AS reason FROM articles""")
def cls02_consumer_fintech(v: Views) -> DataFrame:
    return _lowered(v).select("article_id", classify.consumer_fintech(_name(v), _description(), F.col("text"), F.col("low")).alias("reason"))


@query(f"""SELECT article_id, CASE WHEN {words_sql(_NAME, fixed.CONSUMER_NAMES)} AND NOT {words_sql(_DESC, fixed.ENTERPRISE_DESCRIPTIONS)} THEN 'name' WHEN {count_sql(_X, fixed.CONSUMER_WORDS)} >= 3 THEN 'density'
WHEN {words_sql(_DESC, fixed.CONSUMER_DESCRIPTIONS)} AND NOT {words_sql(_DESC, fixed.ENTERPRISE_DESCRIPTIONS)} THEN 'description' END AS reason FROM articles""")
def cls03_consumer_ai(v: Views) -> DataFrame:
    return _lowered(v).select("article_id", classify.consumer_ai(_name(v), _description(), F.col("text"), F.lit("vertical_saas"), F.col("low")).alias("reason"))


_CATEGORY = "CASE article_id % 6 WHEN 0 THEN 'crypto' WHEN 1 THEN 'fintech' WHEN 2 THEN 'healthcare' WHEN 3 THEN 'hardware' WHEN 4 THEN 'saas' ELSE 'other' END"


@query(f"""SELECT article_id, CASE {' '.join(f"WHEN {_CATEGORY} = '{c}' AND NOT ({words_sql(_X, w)} OR {words_sql(_DESC, w)}) THEN 'other'" for c, w in fixed.CATEGORY_WORDS.items())} ELSE {_CATEGORY} END AS category FROM articles""")
def cls04_grounded_category(v: Views) -> DataFrame:
    return _lowered(v).select("article_id", classify.grounded_category(F.expr(_CATEGORY), F.col("text"), _description(), F.col("low")).alias("category"))


_TITLE_SQL = " OR ".join("regexp_matches(lower(title), '" + p.replace("'", "''") + "')" for p in fixed.TITLE_PATTERNS)


@query(f"SELECT article_id, length(title) < 3 OR {_TITLE_SQL} OR len(list_filter(string_split_regex(title, '\\s+'), lambda w: w <> '')) > 4 OR {words_sql(_T, fixed.TITLE_PARTS)} AS is_title FROM articles")
def cls05_title_as_name(v: Views) -> DataFrame:
    return v.articles.select("article_id", names.looks_like_title(F.col("title")).alias("is_title"))


_AREA = "CASE WHEN length(text) < 1000 THEN greatest(200, CAST(floor(length(text) * 0.4) AS BIGINT)) WHEN instr(text, chr(10)) = 0 THEN 500 ELSE greatest(instr(text, chr(10)) - 1, 500) END"


@query(f"SELECT article_id, length(text) >= 500 AND NOT contains(left({_X}, {_AREA}), 'acme') AND NOT contains(left({_X}, {_AREA}), 'acme') AS background FROM articles")
def cls06_background(v: Views) -> DataFrame:
    return v.articles.select("article_id", classify.background_mention(F.lit("Acme"), F.col("text"), F.lit(False)).alias("background"))


_AI_COUNT, _ENT, _FUND = count_sql(_B, fixed.AI_WORDS), words_sql(_B, fixed.ENTERPRISE_WORDS), words_sql(_B, fixed.FUNDING_WORDS)


def _num(column: str, pattern: str) -> str:
    return f"TRY_CAST(regexp_extract({column}, '{pattern}', 1) AS BIGINT)"


@query(f"""SELECT article_id, CAST(least(100, CASE WHEN contains({_T}, 'launch hn') THEN 30 WHEN contains({_T}, 'show hn') THEN 20 ELSE 0 END + CASE WHEN {_num(_X, 'score[:[:space:]]+([0-9]+)')} >= 200 THEN 25 WHEN {_num(_X, 'score[:[:space:]]+([0-9]+)')} >= 100 THEN 20 WHEN {_num(_X, 'score[:[:space:]]+([0-9]+)')} >= 50 THEN 10 ELSE 0 END
+ CASE WHEN {_num(_X, 'comments?[:[:space:]]+([0-9]+)')} >= 100 THEN 10 ELSE 0 END + CASE WHEN {_AI_COUNT} >= 2 THEN 15 WHEN {_AI_COUNT} = 1 THEN 8 ELSE 0 END + CASE WHEN {_ENT} THEN 10 ELSE 0 END + CASE WHEN {_FUND} THEN 5 ELSE 0 END) AS INTEGER) AS score FROM articles""")
def sco01_hacker_news(v: Views) -> DataFrame:
    return v.articles.select("article_id", scoring.hacker_news(F.col("title"), F.col("text"), F.lit(None).cast("array<string>")).alias("score"))


@query(f"""SELECT article_id, CAST(least(100, 40 + CASE WHEN {_num('title', '(?i)YC[[:space:]]*[WS]([0-9][0-9])')} >= 24 THEN 10 ELSE 0 END + CASE WHEN {_AI_COUNT} >= 2 THEN 20 WHEN {_AI_COUNT} = 1 THEN 10 ELSE 0 END + CASE WHEN {_ENT} THEN 15 ELSE 0 END) AS INTEGER) AS score FROM articles""")
def sco02_y_combinator(v: Views) -> DataFrame:
    return v.articles.select("article_id", scoring.y_combinator(F.col("title"), F.col("text")).alias("score"))


_STARS = _num("title", "(?i)[+]([0-9]+)[[:space:]]*stars?")


@query(f"""SELECT article_id, CAST(least(100, CASE WHEN {_STARS} >= 200 THEN 30 WHEN {_STARS} >= 100 THEN 25 WHEN {_STARS} >= 50 THEN 15 WHEN {_STARS} IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN {_num(_X, 'total[[:space:]]*stars?[:[:space:]]+([0-9]+)')} >= 10000 THEN 10 ELSE 0 END
+ CASE WHEN {_AI_COUNT} >= 2 THEN 20 WHEN {_AI_COUNT} = 1 THEN 10 ELSE 0 END + CASE WHEN {_ENT} THEN 15 ELSE 0 END) AS INTEGER) AS score FROM articles""")
def sco03_github(v: Views) -> DataFrame:
    return v.articles.select("article_id", scoring.github(F.col("title"), F.col("text")).alias("score"))


@query(f"""SELECT article_id, CAST(least(100, CASE WHEN contains({_B}, 'stealth') THEN 40 ELSE 0 END + CASE WHEN regexp_matches({_X}, 'fund[:[:space:]]+[a-z0-9_]+') THEN 30 ELSE 0 END + CASE WHEN {words_sql(_B, fixed.FOUNDING_ROLES)} THEN 20 ELSE 0 END
+ CASE WHEN {_AI_COUNT} >= 1 THEN 15 ELSE 0 END + CASE WHEN {words_sql(_B, fixed.ENGINEERING_ROLES)} THEN 10 ELSE 0 END) AS INTEGER) AS score FROM articles""")
def sco04_job_posts(v: Views) -> DataFrame:
    return v.articles.select("article_id", scoring.job_posts(F.col("title"), F.col("text"), F.lit(None).cast("array<string>")).alias("score"))


# word boundaries that know all letters, as the JVM's do
_TECH = "(^|[^\\pL\\pN_])(" + fixed.TECH_NAME.replace(r"\b(", "").replace(r")\b", "") + ")($|[^\\pL\\pN_])"


@query(f"""SELECT article_id, CAST(least(100, CASE WHEN {words_sql(_X, fixed.SIGNAL_AGENTS)} THEN 35 ELSE 0 END + CASE WHEN regexp_matches({_B}, '{_TECH}') THEN 25 ELSE 0 END + CASE WHEN contains({_X}, 'formation date') AND {words_sql(_X, fixed.RECENT_WORDS)} THEN 15 ELSE 0 END
+ CASE WHEN {words_sql(_T, fixed.AI_NAME_WORDS)} THEN 15 ELSE 0 END) AS INTEGER) AS score FROM articles""")
def sco05_registry_filings(v: Views) -> DataFrame:
    return v.articles.select("article_id", scoring.registry_filing(F.col("title"), F.col("text"), F.lit(None).cast("array<string>")).alias("score"))


@query(f"""SELECT company_id, CAST(CASE WHEN regexp_matches(lower(name), '{_TECH}') THEN 3 ELSE 0 END + CASE WHEN company_id % 5 = 0 THEN 5 ELSE 0 END + CASE WHEN company_id % 200 <= 30 THEN 2 WHEN company_id % 200 <= 90 THEN 1 ELSE 0 END + CASE WHEN contains(lower(name), 'ai') THEN 2 ELSE 0 END AS INTEGER) AS score FROM companies""")
def sco08_entities(v: Views) -> DataFrame:
    agent = F.when(F.col("company_id") % 5 == 0, "Stripe Atlas, Inc.").otherwise("Someone")
    formed = F.date_sub(F.lit(AS_OF), (F.col("company_id") % 200).cast("int"))
    return v.companies.select("company_id", scoring.entity(F.col("name"), agent, formed, AS_OF).alias("score"))


@query(f"""WITH f AS (SELECT deal_id, CAST(CASE WHEN deal_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN is_ai_deal THEN 3 ELSE 0 END + CASE WHEN is_enterprise_ai THEN 2 ELSE 0 END + CASE WHEN amount_usd >= 5000000 THEN 3 WHEN amount_usd >= 1000000 THEN 2 WHEN amount_usd >= 500000 THEN 1 ELSE 0 END
+ CASE WHEN deal_id % 7 = 0 THEN 5 ELSE 0 END + CASE WHEN deal_id % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN regexp_matches(lower(name), '{_TECH}') THEN 2 ELSE 0 END AS INTEGER) AS score FROM deals JOIN companies USING (company_id) WHERE deal_id % 2 = 0 AND is_enterprise_ai AND amount_usd >= 500000)
SELECT deal_id, score, CASE WHEN score >= 10 THEN 'HIGH' WHEN score >= 7 THEN 'STRONG' END AS label FROM f WHERE score >= 3""")
def sco09_filing_matches(v: Views) -> DataFrame:
    rows = v.deals.where("deal_id % 2 = 0 AND is_enterprise_ai AND amount_usd >= 500000").join(v.companies, "company_id")
    state = F.when(F.col("deal_id") % 2 == 0, "DE")
    score = scoring.filing_match(state, F.col("is_ai_deal"), F.col("is_enterprise_ai"), F.col("amount_usd"), F.col("deal_id") % 7 == 0, F.col("deal_id") % 3 == 0, F.lower("name").rlike(fixed.TECH_NAME))
    return rows.select("deal_id", score.alias("score")).where("score >= 3").withColumn("label", scoring.filing_label(F.col("score")))


@query("""WITH f AS (SELECT *, CASE WHEN source IN ('src0', 'src1') THEN 0 ELSE 1 END AS feed FROM articles), u AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY feed, article_id) AS n FROM f WHERE published_date IS NULL OR published_date >= DATE '2001-06-01')
SELECT article_id, url FROM u WHERE n = 1""")
def src07_merged_feeds(v: Views) -> DataFrame:
    """Feeds in order of priority, none from before the cutoff, the first article that is left of each URL."""
    feed = F.when(F.col("source").isin("src0", "src1"), 0).otherwise(1)
    fresh = v.articles.where("published_date IS NULL OR published_date >= DATE '2001-06-01'").withColumn("rank", F.struct(feed, F.col("article_id")))
    return fresh.groupBy("url").agg(F.min_by("article_id", "rank").alias("article_id")).select("article_id", "url")


@query("SELECT source, count(*) AS articles, count(*) FILTER (WHERE contains(lower(text), 'raised') OR contains(lower(text), 'funding')) AS funding, count(DISTINCT url) AS urls FROM articles GROUP BY source")
def apx26_source_counts(v: Views) -> DataFrame:
    low = F.lower("text")
    return v.articles.groupBy("source").agg(F.count("*").alias("articles"), F.count_if(low.contains("raised") | low.contains("funding")).alias("funding"), F.count_distinct("url").alias("urls"))
