"""Duplicate groups by key, and the tiered search for the stored deal that an incoming deal repeats."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import names
from ledgerloom.operators.written import written


def duplicate_groups(deals: DataFrame, key: str) -> DataFrame:
    """Keys shared by several deals: their number, ids in order, and the least id, which is kept."""
    return deals.groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("deal_id")).alias("deal_ids")).where("n > 1").withColumn("kept", F.element_at("deal_ids", 1))


def matching_names(companies: DataFrame) -> DataFrame:
    """``kind, a_id, b_id``: every company with the first one of its normal form (``same``), and first ones whose forms differ by a suffix.

    Classes of equal forms aren't expanded into pairs; names without a normal form are their own lower case.
    """
    norm = names.normal_form(F.col("name"))
    keyed = companies.select("company_id", F.when(norm == "", F.concat(F.lit("="), names.stripped(F.lower("name")))).otherwise(norm).alias("norm"))
    reps = keyed.groupBy("norm").agg(F.min("company_id").alias("rep"))
    same = keyed.join(reps, "norm").where("company_id != rep").select(F.lit("same").alias("kind"), F.col("company_id").alias("a_id"), F.col("rep").alias("b_id"))
    longer = reps.withColumn("block", F.explode(names.block_keys(F.col("norm")))).where("block != norm").select("block", F.col("rep").alias("b_id"))
    suffix = reps.where(F.length("norm") >= 3).join(longer, F.col("norm") == F.col("block")).select(F.lit("suffix").alias("kind"), F.col("rep").alias("a_id"), "b_id")
    return same.unionByName(suffix)


def _ratio_ok(n: Column, other: Column) -> Column:
    """Amounts not too far apart, unless one looks like the valuation of the other; unknown amounts never are."""
    larger, smaller = F.greatest(n, other), F.least(n, other)
    ratio = larger / F.greatest(F.lit(1), smaller)
    valuation = ratio.between(8, 12) & (smaller >= 50_000_000) & (larger >= 400_000_000)
    return F.when((F.coalesce(n, F.lit(0)) == 0) | (F.coalesce(other, F.lit(0)) == 0), True).otherwise((ratio <= 5) | valuation)


#: Slots of stored deals that any dated deal meets where they have no date, and that any undated deal meets.
_UNDATED, _ANY = -(1 << 30), -(1 << 31)


def _slot(day: Column, days: int) -> Column:
    return F.floor(F.unix_date(day) / (2 * days + 1)).cast("int")


def _slots_asked(d: Column, days: int) -> Column:
    """Slots in which a deal meets what lies within so many days: two at most, and that of undated deals."""
    around = F.array_distinct(F.array(_slot(F.date_sub(d, days), days), _slot(F.date_add(d, days), days), F.lit(_UNDATED)))
    return F.when(d.isNotNull(), around).otherwise(F.array(F.lit(_ANY)))


def _slots_held(sd: Column, days: int, undated: Column, any_day: Column) -> Column:
    """Slots of a stored deal; ``undated`` and ``any_day`` say whether it is met by dated deals if it has no date, and by undated ones."""
    return F.array_compact(F.array(_slot(sd, days), F.when(sd.isNull() & undated, _UNDATED), F.when(any_day, _ANY)))


def _step(usd: Column, ratio: float) -> Column:
    """Amounts in steps of a ratio; those under 1000 are one step."""
    return F.floor(F.log(F.greatest(usd, F.lit(1000)).cast("double")) / F.log(F.lit(ratio))).cast("int")


def _steps(low: Column, high: Column, ratio: float) -> Column:
    return F.explode(F.sequence(_step(low, ratio), _step(high, ratio)))


def match_tiers(incoming: DataFrame, stored: DataFrame, as_of: datetime.date) -> DataFrame:
    """``in_id, tier, deal_id`` for each incoming deal with a stored duplicate.

    Both sides have ``deal_id, name, norm, round_type, amount_usd, announced_date, created_date``.  Tiers are numbered in the
    order of the probes; the least tier wins, then the least deal_id.  The probes go in that order too, and only deals that
    none has found yet go on: what is dense is found early.  Each meets by hash joins on all that it compares: names (as
    pairs of distinct names that match), rounds, slots of days and steps of amounts; tier 2 on the beginnings of names.
    """
    low = names.stripped(F.lower(F.col("name")))
    fields = {"deal_id": F.col("deal_id"), "low": low, "key": F.when(F.col("norm") == "", F.concat(F.lit("="), low)).otherwise(F.col("norm")), "norm": F.col("norm"), "round": F.col("round_type"), "usd": F.col("amount_usd"), "day": F.col("announced_date"), "created": F.col("created_date")}
    i = written(incoming.select(*[c.alias(f"i_{name}") for name, c in fields.items()]), "tiers-incoming")
    s = written(stored.select(*[c.alias(name) for name, c in fields.items()]), "tiers-stored")
    n, sn, d, sd = F.col("i_usd"), F.col("usd"), F.col("i_day"), F.col("day")
    known, other_known = F.coalesce(n, F.lit(0)) != 0, F.coalesce(sn, F.lit(0)) != 0
    gap = F.abs(F.datediff(d, sd))
    age, stored_age = F.datediff(F.lit(as_of), "created"), F.datediff(F.lit(as_of), sd)
    seen = F.coalesce(stored_age, age)

    blocks = lambda rows, key: rows.select(key).distinct().withColumn("block", F.explode(names.block_keys(F.col(key))))
    alike = blocks(i, "i_key").join(blocks(s, "key"), "block").where(names.names_match(F.col("i_key"), F.col("key"), F.col("i_key"), F.col("key")))
    alike = written(alike.select("i_key", "key").distinct(), "tiers-names")

    held = lambda rows, days, undated, any_day: rows.withColumn("slot", F.explode(_slots_held(sd, days, undated, any_day)))
    asked = lambda rows, days: rows.withColumn("slot", F.explode(_slots_asked(d, days)))
    found = lambda rows, tier: rows.select(F.col("i_deal_id").alias("in_id"), F.lit(tier).alias("tier"), "deal_id")
    least = lambda rows: written(rows.groupBy("in_id").agg(F.min(F.struct("tier", "deal_id")).alias("best")), "tiers-found")
    left = lambda rows, done: rows.join(done.select(F.col("in_id").alias("i_deal_id")), "i_deal_id", "left_anti")

    # 1: the very name, the round, days at hand
    own = held(s, 5, age <= 10, (sd.isNull() | (stored_age <= 21)) & (age <= 21)).withColumn("day", F.when(F.col("slot") > _UNDATED, sd))
    own = own.groupBy("key", "low", "round", "slot", "day").agg(F.min("deal_id").alias("deal_id"))
    mine = asked(i, 5).withColumnsRenamed({"i_key": "key", "i_low": "low", "i_round": "round"})
    first = least(found(mine.join(own, ["key", "low", "round", "slot"]).where(sd.isNull() | (gap <= 5)), 1))

    # 2: the day, the round, the beginning of the name and the amount
    rest = left(i, first)
    begun = rest.where(known & (F.length("i_norm") >= 3)).withColumns({"round": F.col("i_round"), "day": d, "head": F.substring("i_norm", 1, 4), "step": _steps(F.floor(n * 0.95), F.floor(n * 1.05), 1.12)})
    start = F.greatest(F.lit(4), F.floor(0.6 * F.least(F.length("i_norm"), F.length("norm"))).cast("int"))
    begun = begun.join(s.where(F.length("norm") >= 3).withColumns({"head": F.substring("norm", 1, 4), "step": _step(sn, 1.12)}), ["day", "round", "head", "step"])
    begun = begun.where(sn.between(F.floor(n * 0.95), F.floor(n * 1.05)) & (F.substring(F.col("i_norm"), F.lit(1), start) == F.substring(F.col("norm"), F.lit(1), start)))
    # 3: names that match, the amount, days near
    named = rest.join(alike, "i_key")
    close = held(s.where(sn.isNotNull()), 30, age <= 60, seen <= 60).withColumn("step", _step(sn, 1.25))
    close = asked(named.where(known), 30).withColumn("step", _steps(F.floor(n * 0.9), F.floor(n * 1.1), 1.25)).join(close, ["key", "slot", "step"])
    close = close.where(sn.between(F.floor(n * 0.9), F.floor(n * 1.1)) & (d.isNull() | sd.isNull() | (gap <= 30)))
    # 4 and 5: the very name, and names that match, on the day
    same_day = s.where(sd.isNotNull()).groupBy("key", "low", "day").agg(F.min("deal_id").alias("deal_id"))
    very = rest.withColumns({"key": F.col("i_key"), "low": F.col("i_low"), "day": d}).join(same_day, ["key", "low", "day"])
    matched = named.withColumn("day", d).join(same_day.groupBy("key", "day").agg(F.min("deal_id").alias("deal_id")), ["key", "day"])
    second = least(found(begun, 2).unionByName(found(close, 3)).unionByName(found(very, 4)).unionByName(found(matched, 5)))

    # 6 and 7: names that match, the round, no contradiction in amounts, a month
    named = left(rest, second).join(alike, "i_key").withColumn("round", F.col("i_round"))
    month = asked(named, 30).join(held(s, 30, age <= 30, age <= 30), ["key", "round", "slot"]).where(_ratio_ok(n, sn) & (d.isNull() | sd.isNull() | (gap <= 30)))
    month = month.select(F.col("i_deal_id").alias("in_id"), F.when(d.isNotNull() & sd.isNull(), 7).otherwise(6).alias("tier"), "deal_id")
    # 8: the same within a year, where amounts agree, or within 60 days where one is unknown
    year = held(s.where(other_known), 365, age <= 365, seen <= 365).withColumn("step", _step(sn, 1.2))
    year = asked(named.where(known), 365).withColumn("step", _steps(n * 0.849, n / 0.849, 1.2)).join(year, ["key", "round", "slot", "step"])
    year = year.where((F.abs(n - sn) <= 0.15 * F.greatest(n, sn)) & (d.isNull() | sd.isNull() | (gap <= 365)))
    unknown = asked(named, 60).join(held(s, 60, age <= 365, seen <= 365), ["key", "round", "slot"]).where(~(known & other_known) & (d.isNull() | sd.isNull() | (gap <= 60)))
    third = least(month.unionByName(found(year, 8)).unionByName(found(unknown, 8)))
    return first.unionByName(second).unionByName(third).select("in_id", "best.tier", "best.deal_id")
