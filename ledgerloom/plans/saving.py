"""Saving deals: cases of one company each, and what must become of them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, keys, names
from ledgerloom.operators.save import save
from ledgerloom.operators.written import written
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import AS_OF, Views

_D = datetime.date
TODAY = _D(2026, 1, 31)

#: Stored deal (suffix, round, amount, date, confidence) or none; new ones (suffix, round, amount, source, filed amount, extracted, published); their outcomes; what the first deal then is (amount, date, confidence, sources).
CASES = [
    (None, [("", "seed", "$4M", None, None, _D(2026, 1, 10), None)], ["inserted"], ("$4M", _D(2026, 1, 10), 0.6, 1)),
    (None, [("", "seed", "$4M", None, None, _D(2026, 1, 10), None), ("", "seed", "$4M", None, None, _D(2026, 1, 11), _D(2026, 1, 11)), (" Labs", "seed", "$4M", None, None, _D(2026, 1, 10), None)], ["inserted", "merged", "merged"], ("$4M", _D(2026, 1, 10), 0.8, 3)),
    ((" Labs", "seed", "$1M", _D(2026, 1, 10), 0.5), [("", "seed", "$40M", None, None, _D(2026, 1, 13), None)], ["adjacent key"], ("$1M", _D(2026, 1, 10), 0.5, 1)),
    ((" Labs", "seed", "$1M", _D(2026, 1, 10), 0.5), [("", "seed", "$40M", None, None, _D(2026, 1, 11), None)], ["key"], ("$1M", _D(2026, 1, 10), 0.5, 1)),
    (("", "series_a", "$40M", _D(2026, 1, 10), 0.5), [("", "series_b", "$50M", None, None, _D(2026, 1, 11), None)], ["amount key"], ("$40M", _D(2026, 1, 10), 0.5, 1)),
    (("", "seed", "$4M", _D(2026, 1, 1), 0.5), [("", "seed", "$4M", None, None, _D(2026, 1, 4), _D(2026, 1, 5))], ["merged"], ("$4M", _D(2026, 1, 4), 0.7, 2)),
    (("", "seed", "undisclosed", _D(2026, 1, 9), 0.9), [("", "seed", "$6M", None, None, _D(2026, 1, 12), None)], ["merged"], ("$6M", _D(2026, 1, 9), 0.9, 1)),
    (("", "seed", "$5M", _D(2026, 1, 9), 0.9), [("", "seed", "$5M", "sec_form_d", 5_250_000, _D(2026, 1, 9), None)], ["merged"], ("$5.25M", _D(2026, 1, 9), 0.95, 2)),
    (("", "seed", "$5M", None, 0.5), [("", "seed", "$5M", None, None, None, _D(2026, 1, 20))], ["merged"], ("$5M", _D(2026, 1, 20), 0.4, 1)),
    (("", "seed", "$5M", _D(2025, 1, 9), 0.9), [("", "series_b", "$90M", None, None, _D(2026, 1, 9), None), ("", "series_b", "$90M", None, None, None, _D(2027, 1, 9))], ["inserted", "merged"], ("$5M", _D(2025, 1, 9), 0.9, 1)),
]

_NEW = [(k, j, *n, out[j]) for k, (_, new, out, _) in enumerate(CASES) for j, n in enumerate(new)]


def _sql(x) -> str:
    return "NULL" if x is None else f"DATE '{x}'" if isinstance(x, datetime.date) else str(x) if isinstance(x, (int, float)) else f"'{x}'"


def saved(v: Views) -> tuple[DataFrame, DataFrame]:
    """Each row's company goes through the case of its id."""
    who = v.landed_rows.select("id", (F.col("id") % len(CASES)).cast("int").alias("k"))
    name = lambda suffix: F.concat(F.md5(F.col("id").cast("string")), F.lit(" Firm"), F.col(suffix))
    old = v.spark.createDataFrame([(k, *s) for k, (s, *_) in enumerate(CASES) if s], "k int, suffix string, round_type string, amount string, announced_date date, date_confidence double")
    stored = who.join(F.broadcast(old), "k").select((F.col("id") * 10).alias("deal_id"), name("suffix").alias("name"), "round_type", "amount", "announced_date", "date_confidence")
    stored = written(stored.withColumn("amount_usd", amounts.parsed(F.col("amount"))), "stored").withColumns({
        "norm": names.normal_form(F.col("name")), "amount_source": F.lit("article"), "date_source_count": F.lit(1).cast("long"), "created_date": F.coalesce("announced_date", F.lit(_D(2026, 1, 5))),
        "dedup_key": keys.dedup_key(F.col("name"), F.col("round_type"), F.col("announced_date"), TODAY),
    })
    stored = stored.withColumn("amount_key", keys.amount_key(F.col("name"), F.col("amount_usd"), F.col("announced_date"), TODAY))
    new = v.spark.createDataFrame([r[:-1] for r in _NEW], "k int, j int, suffix string, round_type string, amount string, amount_source string, sec_amount_usd long, round_date date, published_date date")
    new = who.join(F.broadcast(new), "k").select((F.col("id") * 10 + 1 + F.col("j")).alias("new_id"), (F.col("id") * 10 + F.col("j")).alias("seq"), name("suffix").alias("name"), "round_type", "amount", "amount_source", "sec_amount_usd", "round_date", "published_date")
    return save(stored, new, TODAY)


@query(f"WITH c(k, j, outcome) AS (VALUES {', '.join(f'({r[0]}, {r[1]}, {_sql(r[-1])})' for r in _NEW)}) SELECT r.id * 10 + c.j AS seq, c.outcome FROM landed_rows r JOIN c ON r.id % {len(CASES)} = c.k")
def res02_save_outcomes(v: Views) -> DataFrame:
    """What becomes of new deals, saved in order of arrival within each company."""
    return saved(v)[1].select("seq", "outcome")


@query(f"WITH c(k, amount, announced_date, date_confidence, date_source_count) AS (VALUES {', '.join('(' + ', '.join(map(_sql, (k, *end))) + ')' for k, (*_, end) in enumerate(CASES))}) SELECT r.id, c.amount, c.announced_date, CAST(c.date_confidence AS DOUBLE) AS date_confidence, c.date_source_count FROM landed_rows r JOIN c ON r.id % {len(CASES)} = c.k")
def res02_saved_deals(v: Views) -> DataFrame:
    """The first deal of each company after saving."""
    deals = saved(v)[0].withColumn("id", F.floor(F.col("deal_id") / 10)).groupBy("id").agg(F.min_by(F.struct("amount", "announced_date", F.round("date_confidence", 6).alias("date_confidence"), "date_source_count"), "deal_id").alias("d"))
    return deals.select("id", "d.*")


def _reported(v: Views) -> tuple[DataFrame, DataFrame]:
    """All orders as stored deals, and all their lines as reports of deals: the same company under other suffixes, another day, amount and source."""
    suffix = lambda k: F.element_at(F.array(*map(F.lit, ["", " Labs", " AI", ", Inc.", " Health"])), (k % 5 + 1).cast("int"))
    stem = F.substring(F.md5(F.col("company_id").cast("string")), 1, 12)
    deals = v.deals.select("deal_id", F.concat(stem, suffix(F.col("company_id"))).alias("name"), "round_type", F.when(F.col("amount_usd").isNotNull(), amounts.exact(F.col("amount_usd"))).alias("amount"), "amount_usd", "announced_date", "created_date")
    deals = written(deals.withColumn("norm", names.normal_form(F.col("name"))), "stored").withColumns({
        "amount_source": F.lit("article"), "date_confidence": F.lit(0.5), "date_source_count": F.lit(1).cast("long"),
        "dedup_key": keys.dedup_key_of(F.col("norm"), F.col("round_type"), F.col("announced_date"), AS_OF), "amount_key": keys.amount_key_of(F.col("norm"), F.col("amount_usd"), F.col("announced_date"), AS_OF),
    })
    line, k = v.table("lineitem"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    whole = F.round(F.col("l_extendedprice") * 1000).cast("long")
    filed = F.col("l_linenumber") % 4 == 0
    new = line.join(v.deals.select(F.col("deal_id").alias("l_orderkey"), "company_id", "round_type"), "l_orderkey").select(
        (k + 10_000_000_000).alias("new_id"), k.alias("seq"), F.concat(stem, suffix(F.col("l_partkey"))).alias("name"), "round_type", F.when(F.col("l_partkey") % 6 > 0, amounts.exact(whole)).alias("amount"),
        F.when(filed, "sec_form_d").alias("amount_source"), F.when(filed, whole).alias("sec_amount_usd"), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_shipdate").cast("date")).alias("round_date"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_commitdate").cast("date") if "l_commitdate" in line.columns else F.date_add(F.col("l_shipdate").cast("date"), 3)).alias("published_date"),
    )
    return deals, new


@query(None)
def res02_saved_reports(v: Views) -> DataFrame:
    """What becomes of a report of every line, saved over the deals of all orders; tests hold it against a plain loop over all deals."""
    return save(*_reported(v), AS_OF)[1]
