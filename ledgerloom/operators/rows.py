"""Deals as the rows that clients read: one struct each, with everything that belongs to a deal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import urls

FOUNDERS = "array<struct<name:string,title:string,linkedin_url:string>>"


def deal_rows(deals: DataFrame, investors: DataFrame, companies: DataFrame, articles: DataFrame) -> DataFrame:
    """``deal_id, row``: names, roles, the lead, founders, the first article and links that are addresses.

    Investors (``deal_id, position, investor_name, is_lead, is_tracked_fund``) give roles in order of position and the last
    tracked lead (of one position the last by name); without any the deal is a stealth one.  Founders that aren't a JSON list are none, ones without a name are
    "Unknown", and a link with a placeholder's letters in it ("n/a", also in "/in/a...") is none.  The first article is that of least id.  All three are grouped before they meet the deals, so that each
    deal's row is made in one place whatever number of articles it has.
    """
    role = F.when(F.col("is_lead"), "lead").otherwise("non_lead")
    led = F.col("is_lead") & F.col("is_tracked_fund")
    of_investors = investors.groupBy("deal_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("position", role.alias("role")))), lambda x: x["role"]).alias("roles"), F.max(F.when(led, F.struct("position", "investor_name")))["investor_name"].alias("lead_investor"),
    )
    named = F.when(F.coalesce("source", F.lit("")) != "", F.col("source")).otherwise(F.col("title"))
    of_articles = articles.groupBy("deal_id").agg(F.min_by(F.struct("url", named.alias("name")), "article_id").alias("article"))
    address = lambda c: F.when(urls.is_url(c), c)
    of_companies = companies.select("company_id", "name", address(F.col("website")).alias("website"), address(F.col("linkedin_url")).alias("linkedin"))
    real = lambda f: F.struct(F.coalesce(f["name"], F.lit("Unknown")).alias("name"), f["title"].alias("title"), address(f["linkedin_url"]).alias("linkedin_url"))
    joined = deals.join(of_companies, "company_id", "left").join(of_investors, "deal_id", "left").join(of_articles, "deal_id", "left")
    row = F.struct(
        F.col("deal_id").cast("string").alias("id"), F.coalesce("name", F.lit("Unknown")).alias("startup_name"), F.coalesce("roles", F.array(F.lit("stealth"))).alias("investor_roles"), F.col("round_type").alias("investment_stage"),
        F.when(F.coalesce("amount", F.lit("")) != "", F.col("amount")).otherwise("Undisclosed").alias("amount_invested"), F.coalesce(F.date_format("announced_date", "yyyy-MM-dd"), F.lit("")).alias("date"), "enterprise_category", "is_enterprise_ai",
        F.coalesce("is_ai_deal", "is_enterprise_ai").alias("is_ai_deal"), "lead_investor", F.col("website").alias("company_website"), F.col("linkedin").alias("company_linkedin"), F.col("article.url").alias("source_url"), F.col("article.name").alias("source_name"),
        F.transform(F.from_json("founders_json", FOUNDERS), real).alias("founders"),
    )
    return joined.select("deal_id", row.alias("row"))
