"""Merging what several sources say about a deal, and numbering rows without gaps."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates


def date_confidence(article: Column, extracted: Column, as_of: datetime.date) -> Column:
    """How sure a date is: two sources that agree .70 or don't .55, extraction alone .60, article alone .40, none .50."""
    both = F.when(F.abs(F.datediff(article, extracted)) > 14, 0.55).otherwise(0.70)
    return F.when(article.isNotNull() & extracted.isNotNull(), both).when(extracted.isNotNull(), 0.60).when(article <= F.lit(as_of), 0.40).otherwise(0.50)


def merged_date(old: Column, old_sure: Column, new: Column, new_sure: Column) -> Column:
    """``date, sure`` after a new report of the same deal; the first rule that holds."""
    out = lambda d, c: F.struct(d.alias("date"), c.alias("sure"))
    top = F.greatest(old_sure, new_sure)
    return (
        F.when(new.isNull(), out(old, old_sure))
        .when(old.isNull(), out(new, new_sure))
        .when(F.abs(F.datediff(new, old)) <= 1, out(old, F.least(F.lit(0.95), old_sure + 0.1)))
        .when(new_sure > old_sure, out(new, new_sure))
        .when(dates.is_placeholder(old) & ~dates.is_placeholder(new), out(new, top))
        .when((new < old) & (new_sure >= old_sure - 0.1), out(new, top))
        .otherwise(out(old, old_sure))
    )


def merged_amount(old: Column, old_source: Column, new: Column, new_source: Column) -> Column:
    """Filings override other sources; else a real amount replaces none."""
    filed = (new_source == "sec_form_d") & (F.coalesce(old_source, F.lit("")) != "sec_form_d") & amounts.is_real(new)
    return F.when(filed | (amounts.is_real(new) & ~amounts.is_real(old)), new).otherwise(old)


def date_votes(evidence: DataFrame) -> DataFrame:
    """``deal_id, date, sure, sources`` from ``deal_id, seq, date, confidence``: clusters of a day around their first date, folded in order of ``seq``."""
    cluster = "array<struct<date:date,sure:double,n:bigint>>"

    def put(clusters: Column, x: Column) -> Column:
        near = lambda c: F.abs(F.datediff(x["date"], c["date"])) <= 1
        place = F.array_position(F.transform(clusters, near), True)
        grown = F.transform(clusters, lambda c, i: F.when(i + 1 == place, F.struct(c["date"].alias("date"), (c["sure"] + x["confidence"]).alias("sure"), (c["n"] + 1).alias("n"))).otherwise(c))
        return F.when(place > 0, grown).otherwise(F.concat(clusters, F.array(F.struct(x["date"].alias("date"), x["confidence"].alias("sure"), F.lit(1).cast("long").alias("n")))))

    runs = evidence.groupBy("deal_id").agg(F.sort_array(F.collect_list(F.struct("seq", "date", "confidence"))).alias("run"))
    folded = runs.select("deal_id", F.aggregate("run", F.array().cast(cluster), put).alias("clusters"))
    sure = lambda c: F.least(F.lit(1.0), c["sure"] + F.when(c["n"] >= 2, 0.1).otherwise(0.0))
    best = F.array_max(F.transform("clusters", lambda c, i: F.struct(sure(c).alias("sure"), (-i).alias("rank"), c["date"].alias("date"), c["n"].alias("sources"))))
    return folded.select("deal_id", best.alias("b")).select("deal_id", "b.date", "b.sure", "b.sources")


def dense_positions(items: DataFrame, group: str, *order: str) -> DataFrame:
    """Positions 0, 1, 2, ... within each group."""
    return items.withColumn("position", (F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1).cast("long"))
