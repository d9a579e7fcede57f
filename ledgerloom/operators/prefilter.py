"""Filters that articles pass before extraction, and deduplication of their contents."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import classify, text, urls


def cap_per_source(articles: DataFrame, rows: int, order: str = "article_id") -> DataFrame:
    """The first rows of each source."""
    return articles.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy(order))).where(F.col("_n") <= rows).drop("_n")


def first_per_url(articles: DataFrame, order: str = "article_id") -> DataFrame:
    """The first article of each normalised URL."""
    keyed = articles.withColumn("normal_url", urls.normalised(F.col("url")))
    first = keyed.groupBy("normal_url").agg(F.min(order).alias(order))
    return keyed.join(first, ["normal_url", order], "left_semi")


def unseen(articles: DataFrame, stored: DataFrame) -> DataFrame:
    """Articles whose URL is stored neither as it is nor normalised."""
    tried = articles.select("article_id", F.explode(F.array_distinct(F.array("url", urls.normalised(F.col("url"))))).alias("url"))
    seen = tried.join(stored.select("url"), "url", "left_semi").select("article_id").distinct()
    return articles.join(seen, "article_id", "left_anti")


def judged(articles: DataFrame) -> DataFrame:
    """``verdict`` of every article: the first filter that drops it, or ``keep``."""
    skip = classify.source_skip(F.col("source"), F.col("url"), F.col("title"))
    verdict = F.when(skip.isNotNull(), F.concat(F.lit("source: "), skip)).when(classify.no_announcement(F.col("title")), "title").when(~classify.likely_funding(F.col("title")), "not funding")
    return articles.withColumn("verdict", verdict.otherwise("keep"))


def fresh_contents(articles: DataFrame, stored: DataFrame, as_of: datetime.date, order: str = "article_id", one_of_twins: bool = True) -> DataFrame:
    """Articles whose content isn't stored, or stored much shorter: more than twice as long and over 100 characters.

    ``stored`` has ``content_hash, content_length, expires_on``; expired rows don't count.  Articles without text stay.  Of
    articles of one batch with the same content the first stays, or all of them if ``one_of_twins`` is false.
    """
    # texts are read once, for their hash and length, and don't go through the joins
    light = articles.select(order, text.content_fingerprint(F.col("text")).alias("content_hash"), F.length("text").alias("_length"))
    live = stored.where(F.col("expires_on") > F.lit(as_of)).groupBy("content_hash").agg(F.max("content_length").alias("stored_length"))
    kept = light.join(live, "content_hash", "left").where((F.col("content_hash") == "") | F.col("stored_length").isNull() | (F.col("_length") > F.greatest(F.lit(100), 2 * F.col("stored_length"))))
    if one_of_twins:
        kept = kept.groupBy("content_hash", F.when(F.col("content_hash") == "", F.col(order)).alias("_own")).agg(F.min(order).alias(order))
    return articles.join(kept.select(order, "content_hash"), order)
