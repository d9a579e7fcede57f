"""Enrichment of deals and companies from landed search results; the first acceptable result wins."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates, people
from ledgerloom.functions.text import lowered


def filers(companies: DataFrame, found: DataFrame, most: int = 10, least: float = 0.6) -> DataFrame:
    """``company_id, cik, sec_name``: of a company's first results (``company_id, rank, sec_name, cik``) the one most like its name, if enough so."""
    met = companies.select("company_id", "name").join(found.where(F.col("rank") <= most), "company_id").withColumn("ratio", people.likeness(F.lower("name"), F.lower("sec_name")))
    best = met.where(F.col("ratio") > least).groupBy("company_id").agg(F.max_by(F.struct("cik", "sec_name"), F.struct("ratio", -F.col("rank"))).alias("b"))
    return best.select("company_id", F.lpad("b.cik", 10, "0").alias("cik"), "b.sec_name")


def recent_filings(submissions: DataFrame, as_of: datetime.date, days: int = 365) -> DataFrame:
    """``cik, form, filed, url`` of Form D filings in submissions (``cik, forms, filed, accessions`` as parallel arrays)."""
    rows = submissions.select("cik", F.explode(F.arrays_zip("forms", "filed", "accessions")).alias("z")).select("cik", F.col("z.forms").alias("form"), F.try_to_date("z.filed", "yyyy-MM-dd").alias("filed"), F.coalesce("z.accessions", F.lit("")).alias("accession"))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), "cik", F.lit("/"), F.replace("accession", F.lit("-"), F.lit("")), F.lit("/primary_doc.xml"))
    return rows.where(F.col("form").isin("D", "D/A") & (F.col("filed") >= F.date_sub(F.lit(as_of), days))).select("cik", "form", "filed", url.alias("url"))


def announced(deals: DataFrame, results: DataFrame, as_of: datetime.date) -> DataFrame:
    """``deal_id, found_date, date_source, confidence``: from the first result (``deal_id, query, rank, title, description, page_age``) that names the company and has a date."""
    met = deals.select("deal_id", lowered(F.col("name")).alias("_name")).join(results, "deal_id")
    both = F.concat(lowered(F.col("title")), F.lit(" "), lowered(F.col("description")))
    named = both.contains(F.col("_name")) | both.contains(F.element_at(F.split("_name", r"\s+"), 1))
    aged, told, titled = dates.relative(F.col("page_age"), as_of), dates.of_snippet(F.col("description"), as_of), dates.of_snippet(F.col("title"), as_of)
    source = F.when(aged.isNotNull(), "page_age").when(told.isNotNull(), "snippet").when(titled.isNotNull(), "title")
    dated = met.where(named & ~F.col("_name").isin("", "<unknown>", "unknown", "n/a")).select("deal_id", "query", "rank", F.coalesce(aged, told, titled).alias("found_date"), source.alias("date_source")).where("found_date IS NOT NULL")
    first = dated.groupBy("deal_id").agg(F.min_by(F.struct("found_date", "date_source"), F.struct("query", "rank")).alias("f"))
    return first.select("deal_id", "f.*", F.when(F.col("f.date_source") == "page_age", "high").when(F.col("f.date_source") == "snippet", "medium").otherwise("low").alias("confidence"))


def websites(companies: DataFrame, results: DataFrame) -> DataFrame:
    """``company_id, website``: the first result (``company_id, rank, url``) that may be the company's own."""
    met = companies.select("company_id", "name").join(results, "company_id").where(people.startup_site(F.col("url"), F.col("name")))
    return met.groupBy("company_id").agg(F.min_by("url", "rank").alias("website"))


def founders(known: DataFrame, results: DataFrame) -> DataFrame:
    """``company_id, founder, linkedin_url``: a founder's address if known, else the first valid profile found, else that of the chief executive, if of that name.

    ``known``: company_id, company, founder, linkedin_url; ``results``: company_id, founder, rank, title, description, url, where
    ``founder`` is null in searches for the chief executive.
    """
    from ledgerloom.functions.names import person_names_match

    r = results.withColumn("link", people.profile_link(F.col("url"))).where("link IS NOT NULL").withColumn("facts", people.profile_facts(F.col("title"), F.col("description"), F.lit(None).cast("string")))
    asked = known.join(r.where("founder IS NOT NULL"), ["company_id", "founder"]).where(people.valid_founder(F.col("facts"), F.col("company")))
    own = asked.groupBy("company_id", "founder").agg(F.min_by("link", "rank").alias("found"))
    out = known.join(own, ["company_id", "founder"], "left").withColumn("linkedin_url", F.coalesce(F.nullif("linkedin_url", F.lit("")), "found")).drop("found")
    none = out.groupBy("company_id").agg(F.count("linkedin_url").alias("n")).where("n = 0").select("company_id")
    chief = r.where("founder IS NULL").withColumn("person", people.name_of_title(F.col("title"))).where("person IS NOT NULL").groupBy("company_id").agg(F.min_by(F.struct("person", "link"), "rank").alias("chief")).join(none, "company_id")
    out = out.join(chief, "company_id", "left")
    fallback = F.when(person_names_match(F.col("founder"), F.col("chief.person")), F.col("chief.link"))
    return out.select("company_id", "founder", F.coalesce("linkedin_url", fallback).alias("linkedin_url"))


def looked_up(wanted: DataFrame, cache: DataFrame, now: datetime.datetime, days: int = 30) -> DataFrame:
    """``key, state, value``: what a cache of lookups (``key, value, stored_at``; a null value found nothing) knows: hit, nothing or miss."""
    live = cache.where(F.col("stored_at") > F.lit(now - datetime.timedelta(days=days))).groupBy("key").agg(F.max_by(F.struct("value"), "stored_at").alias("c"))
    out = wanted.join(live, "key", "left")
    return out.select("key", F.when(F.col("c").isNull(), "miss").when(F.col("c.value").isNull(), "nothing").otherwise("hit").alias("state"), "c.value")


def surer_dates(deals: DataFrame, found: DataFrame) -> DataFrame:
    """Deals (``announced_date, date_confidence``) with found dates (``found_date, sure``) where they are surer, or where there was none."""
    better = F.col("found_date").isNotNull() & (F.col("announced_date").isNull() | (F.col("sure") > F.coalesce("date_confidence", F.lit(0.0))))
    out = deals.join(found.select("deal_id", "found_date", "sure"), "deal_id", "left")
    return out.withColumns({"announced_date": F.when(better, F.col("found_date")).otherwise(F.col("announced_date")), "date_confidence": F.when(better, F.col("sure")).otherwise(F.col("date_confidence"))}).drop("found_date", "sure")


def with_filing(deals: DataFrame, matches: DataFrame) -> DataFrame:
    """Deals with the date and address of their filing (``deal_id, filed, url, confident``); only a confident match replaces their date."""
    out = deals.join(matches, "deal_id", "left")
    sure = F.coalesce("confident", F.lit(False))
    return out.withColumns({
        "announced_date": F.when(sure, F.col("filed")).otherwise(F.col("announced_date")), "date_confidence": F.when(sure, 0.95).otherwise(F.col("date_confidence")), "sec_filing_date": F.col("filed"), "sec_filing_url": F.col("url"),
    }).drop("filed", "url", "confident")
