"""Scan jobs: what each source reported, what hangs, what a run amounts to."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_results(scans: DataFrame, key: str, raw: str) -> DataFrame:
    """A row for each source in a scan's JSON report; entries that are no objects, totals and malformed reports give none."""
    each = scans.select(key, F.explode(F.from_json(raw, "map<string,string>")).alias("source", "stats")).where("source != 'total_deals_saved'")
    fields = "error string, articles_received long, articles_found long, deals_extracted long, deals_saved long, articles_skipped_duplicate long, errors long"
    s = each.where(F.col("stats").startswith("{")).withColumn("s", F.from_json("stats", fields))
    count = lambda c: F.when(F.col("s.error").isNotNull(), 0).otherwise(F.coalesce(f"s.{c}", F.lit(0))).cast("long").alias(c)
    found = F.when(F.col("s.error").isNotNull(), 0).otherwise(F.coalesce("s.articles_received", "s.articles_found", F.lit(0))).cast("long")
    return s.select(key, "source", found.alias("articles_found"), count("deals_extracted"), count("deals_saved"), count("articles_skipped_duplicate"), count("errors"), F.col("s.error").alias("error_message"))


def failed_if_stale(scans: DataFrame, now: datetime.datetime, hours: int = 1) -> DataFrame:
    """Scans still running so long after their start become failed, with a reason."""
    stale = (F.col("status") == "running") & (F.col("started_at") < F.lit(now - datetime.timedelta(hours=hours)))
    return scans.withColumns({"status": F.when(stale, "failed").otherwise(F.col("status")), "error_message": F.when(stale, "Marked as failed by cleanup (stuck >1 hour)")})


def health(stats: DataFrame, expected_empty: list[str]) -> DataFrame:
    """One row for a run from ``source, failed, articles, saved, conf_below_035, conf_035_050, conf_050_065, conf_above_065, rejected``: counts, sources without results, health in per cent."""
    silent = F.array_sort(F.collect_list(F.when(~F.col("failed") & (F.col("articles") == 0) & ~F.col("source").isin(expected_empty), F.col("source"))))
    bands = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("conf_below_035", "conf_035_050", "conf_050_065", "conf_above_065", "rejected")]
    good = F.count_if(~F.col("failed"))
    return stats.agg(
        F.count("*").alias("sources"), good.alias("successful"), F.count_if("failed").alias("failed"), F.coalesce(F.sum("articles"), F.lit(0)).alias("articles"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"), *bands,
        F.array_join(silent, ",").alias("zero_result"), F.round(F.when(F.count("*") > 0, 100.0 * good / F.count("*")).otherwise(0.0), 1).alias("health"),
    )


def band(confidence: Column) -> Column:
    return F.when(confidence < 0.35, "below 0.35").when(confidence < 0.50, "below 0.50").when(confidence < 0.65, "below 0.65").otherwise("0.65 and over")


def finished(scans: DataFrame, updates: DataFrame) -> DataFrame:
    """Scan jobs (``scan_id, status, started_at``) with their ends (``scan_id, ended_at, status, deals_saved, articles_found``): duration in seconds, totals 0 where unknown."""
    u = updates.select("scan_id", "ended_at", F.col("status").alias("_status"), "deals_saved", "articles_found")
    out = scans.select("scan_id", "status", "started_at").join(u, "scan_id", "left")
    seconds = F.unix_timestamp("ended_at") - F.unix_timestamp("started_at")
    return out.select("scan_id", F.coalesce("_status", "status").alias("status"), seconds.alias("duration_seconds"), F.coalesce("deals_saved", F.lit(0)).alias("deals_saved"), F.coalesce("articles_found", F.lit(0)).alias("articles_found"))


def summary(results: DataFrame, funds: DataFrame) -> DataFrame:
    """One row of alert text: sources with deals and how many (``source, deals``), funds with deals (``fund, deals``)."""
    listed = lambda df, c, name: df.where("deals > 0").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col(c), F.lit(": "), F.col("deals").cast("string")))), ", ").alias(name))
    totals = results.agg(F.coalesce(F.sum("deals"), F.lit(0)).alias("deals"))
    return totals.crossJoin(F.broadcast(listed(results, "source", "sources"))).crossJoin(F.broadcast(listed(funds, "fund", "funds")))  # one row each


def deals_in_order(batches: DataFrame) -> DataFrame:
    """Deals of batch extractions (``article_id, deals array``): each with its place; an article whose extraction failed (null) keeps a row without a deal."""
    return batches.select("article_id", F.posexplode_outer("deals").alias("place", "deal"))
