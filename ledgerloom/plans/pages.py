"""Page, feed, post and trademark tests over the articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import fixed, pages
from ledgerloom.plans.registry import count_sql, query, words_sql
from ledgerloom.plans.views import Views

_FUNDS = ["accel", "gv", "sequoia", "thrive", "benchmark", "index"]
_ADDED = ["Accel Entertainment casino", "NYSE:GV rises", "Peak XV invests", "Round led by Thrive", "Benchmark Electronics", "Our investment in Acme - hello", "Introducing: Beta", "growth buyout", "Thrive Global"]
_FUND = "CASE article_id % 6 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_FUNDS)) + " END"
_LINE = "CASE (article_id * 7) % 9 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_ADDED)) + " END"
_LOW = f"lower({_LINE})"
_BOTH = f"(lower({_LINE}) || ' ' || lower(text))"


def _lines(v: Views) -> DataFrame:
    return v.articles.select("article_id", "text", F.expr(_FUND).alias("fund"), F.expr(_LINE).alias("line"))


@query("SELECT article_id, CASE " + " ".join(f"WHEN {_FUND} = '{k}' AND {words_sql(_LOW if k in fixed.TITLE_ONLY_PAGES else _BOTH, w)} THEN 'excluded'" for k, w in fixed.PAGE_EXCLUDES.items()) + " " + " ".join(f"WHEN {_FUND} = '{k}' AND NOT {words_sql(_BOTH, w)} THEN 'unverified'" for k, w in fixed.PAGE_REQUIRES.items()) + " ELSE 'kept' END AS verdict FROM articles")
def pre20_page_verdicts(v: Views) -> DataFrame:
    return _lines(v).select("article_id", pages.page_verdict(F.col("fund"), F.col("line"), F.col("text")).alias("verdict"))


@query(f"SELECT article_id, NOT {words_sql(_BOTH, fixed.CRYPTO_NOISE)} AND {words_sql(_BOTH, fixed.VENTURE_WORDS)} AS venture, {count_sql('lower(text)', fixed.POST_WORDS)} >= 2 AS post FROM articles")
def pre27_feed_and_post_tests(v: Views) -> DataFrame:
    return _lines(v).select("article_id", pages.venture_feed(F.col("line"), F.col("text")).alias("venture"), pages.funding_post(F.col("text")).alias("post"))


@query(f"SELECT article_id, {words_sql(_LOW, fixed.MARK_WORDS)} OR article_id % 2 = 0 AS tech, {words_sql(_LOW, fixed.MARK_STARTUPS)} OR len(string_split({_LINE}, ' ')) <= 4 AS startup FROM articles")
def pre31_trademarks(v: Views) -> DataFrame:
    nice = F.when(F.col("article_id") % 2 == 0, "009").otherwise("025")
    return _lines(v).select("article_id", pages.tech_mark(F.col("line"), F.lit(None).cast("string"), nice).alias("tech"), pages.startup_mark(F.col("line"), F.lit(None).cast("string")).alias("startup"))


@query(f"SELECT article_id, CASE WHEN contains({_BOTH}, 'scaleup') OR contains({_BOTH}, 'scale up') THEN 'SCALEUP' WHEN contains({_BOTH}, 'growth') THEN 'GROWTH' WHEN contains({_BOTH}, 'buyout') OR contains({_BOTH}, 'acquisition') THEN 'PE/BUYOUT' END AS label, CASE (article_id * 7) % 9 WHEN 5 THEN 'Acme' WHEN 6 THEN 'Beta' END AS company FROM articles")
def pre38_growth_labels(v: Views) -> DataFrame:
    return _lines(v).select("article_id", pages.growth_label(F.col("line"), F.col("text")).alias("label"), pages.company_of_title(F.col("line")).alias("company"))
