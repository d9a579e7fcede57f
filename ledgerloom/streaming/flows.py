"""Streaming forms: articles without repeats, latest positions, stuck scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text, urls


def unique_articles(articles: DataFrame, keep: str = "30 days") -> DataFrame:
    """The first article of each content within the time that contents are remembered; ``articles`` has ``ts, text, url``."""
    keyed = articles.withColumn("content_hash", text.content_fingerprint(F.col("text"))).withColumn("normal_url", urls.normalised(F.col("url")))
    return keyed.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["content_hash"])


def latest_positions(states: DataFrame) -> DataFrame:
    """The last state of each aircraft; for ``update`` output."""
    return states.groupBy("icao").agg(F.max_by(F.struct("lat", "lon", "altitude", "seen_at"), "seen_at").alias("s")).select("icao", "s.*")


def stuck_scans(scans: DataFrame, now, silence: int = 300) -> DataFrame:
    """Running scans whose heartbeat, or start where there is none, is older than ``silence`` seconds."""
    since = F.coalesce("last_heartbeat", "started_at")
    return scans.where((F.col("status") == "running") & (since < F.lit(now) - F.expr(f"INTERVAL {silence} SECONDS")))


def usage_by_window(usage: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tokens by source and window of time, for ``append`` output once a window can't change any more."""
    return usage.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "source_name").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls")).select("w.start", "source_name", "tokens", "calls")
