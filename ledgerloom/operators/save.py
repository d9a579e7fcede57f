"""Saving extracted deals: each is merged into the stored deal that it repeats, or hits a key, or becomes a deal.

Deals of one company are saved in order of arrival, as each changes what the next one meets.  Companies that may meet by the
beginning of their names on one day (tier 2) are one block with all that they lead to; blocks are independent.  One shuffle
brings the deals of a block together, sorted, and one pass folds them (``fold``); only deals that are new or changed are
written, and stored deals of blocks without new ones don't come to the fold.

Rows without a name match nothing and are told apart by their keys alone.  Names without Latin letters or digits have one
normal form, so that they share keys and are one company, as what is stored of them is at most one deal a round and bucket.
No new deals: nothing changes.  ``seq`` and ids are unique.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, fixed, keys, names
from ledgerloom.operators import fold, merge
from ledgerloom.operators.linked import linked_groups
from ledgerloom.operators.written import written

STORED = ["deal_id", "name", "norm", "round_type", "amount", "amount_usd", "amount_source", "announced_date", "date_confidence", "date_source_count", "created_date", "dedup_key", "amount_key"]

#: Amounts within 5 % of one another are in neighbouring steps of this ratio; smaller ones than the least count as it.
STEP, LEAST = 1.06, 1000


def company_key(norm: Column) -> Column:
    """The part of a name that matching names share: its normal form without the suffixes that one may have over another."""
    return F.coalesce(F.regexp_replace(norm, "^(.{3,}?)(?:" + "|".join(fixed.MATCH_SUFFIXES) + ")+$", "$1"), F.lit(""))


def _parsed(incoming: DataFrame, as_of: datetime.date) -> DataFrame:
    """New deals as they would be stored, without their keys."""
    extracted, published = F.col("round_date"), F.col("published_date")
    day = F.coalesce(extracted, F.when(published <= F.lit(as_of), published))
    filed = F.coalesce((F.col("sec_amount_usd") != 0) & (F.col("amount_source") == "sec_form_d"), F.lit(False))
    return incoming.select(
        F.col("new_id").cast("long").alias("deal_id"), F.col("seq").cast("long").alias("seq"), "name", names.normal_form(F.col("name")).alias("norm"), "round_type", F.when(filed, amounts.exact(F.col("sec_amount_usd"))).otherwise(F.col("amount")).alias("amount"),
        F.when(filed, F.col("sec_amount_usd")).otherwise(amounts.parsed_or_plain(F.col("amount"))).alias("amount_usd"), F.coalesce("amount_source", F.lit("article")).alias("amount_source"), day.alias("announced_date"),
        merge.date_confidence(published, extracted, as_of).cast("double").alias("date_confidence"), F.lit(1).cast("long").alias("date_source_count"), F.lit(as_of).alias("created_date"), filed.alias("filed"),
    )


def _keyed(new: DataFrame, as_of: datetime.date) -> DataFrame:
    """New deals with their keys; the fold has them made after its shuffle, as four hashes are longer than all else of a deal."""
    norm, day = F.col("norm"), F.col("announced_date")
    return new.withColumns({"dedup_key": keys.dedup_key_of(norm, F.col("round_type"), day, as_of), "amount_key": keys.amount_key_of(norm, F.col("amount_usd"), day, as_of), "adjacent": keys.adjacent_keys_of(norm, F.col("round_type"), day, as_of)})


def prepared(incoming: DataFrame, as_of: datetime.date) -> DataFrame:
    """New deals (``new_id, seq, name, round_type, amount, amount_source, sec_amount_usd, round_date, published_date``) as they would be stored."""
    return _keyed(written(_parsed(incoming, as_of), "save-parsed"), as_of)


def shared_starts(companies: DataFrame) -> DataFrame:
    """``company, cut, start, whole``: the beginnings that a company shares with another, one of them no longer than ``cut`` (``whole``).

    Found from names alone, so that companies whose beginning no other one has (most of them) bring none of their deals to the search.
    """
    size = F.length("company")
    start = F.substring("company", F.lit(1), F.least(F.col("cut"), F.greatest(F.lit(4), F.floor(F.col("cut") * 0.6).cast("int"))))
    sizes = F.broadcast(companies.select(size.alias("cut")).distinct())  # as many as names have lengths
    starts = companies.withColumn("cut", F.explode(F.sequence(F.lit(3), size))).join(sizes, "cut").withColumn("start", start).withColumn("whole", F.col("cut") == size)
    shared = starts.groupBy("cut", "start").agg(F.count("*").alias("n"), F.max("whole").alias("w")).where("n > 1 AND w").select("cut", "start")
    return written(starts.join(shared, ["cut", "start"]).select("company", "cut", "start", "whole"), "save-starts")


def company_links(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs of companies ``a, b`` of which a new deal of one may meet a deal of the other by the beginning of its name.

    A deal may take its day from one report and its amount from another, so that any day and any amount of a company count.
    Companies meet under a day, the length of the shorter name and the beginning that it asks for, then under a step of amounts.
    """
    size = F.length("company")
    known = (F.col("amount_usd") > 0) & (size >= 3)
    facts = lambda df: df.where(size >= 3).select("company", "announced_date", "amount_usd")
    places = shared_starts(facts(stored).union(facts(new)).select("company").distinct())
    if places.isEmpty():
        return places.select(F.col("company").alias("a"), F.col("start").alias("b"))
    some = places.select("company").distinct()
    every = facts(stored).union(facts(new)).join(some, "company", "left_semi")
    step = F.floor(F.log(F.greatest(F.col("amount_usd"), F.lit(LEAST)).cast("double")) / F.log(F.lit(STEP)))
    theirs = every.select("company", "announced_date").where("announced_date IS NOT NULL").distinct()
    mine = new.where(known & F.col("announced_date").isNotNull()).select("company", "announced_date", F.col("amount_usd").alias("n")).join(some, "company", "left_semi").distinct()
    at = lambda df, whole: df.join(places.where(F.col("whole") == whole).drop("whole"), "company")
    pairs = lambda x, y: x.join(y.withColumnRenamed("company", "other"), ["announced_date", "cut", "start"]).where("company != other").select("company", "other", "n")
    met = pairs(at(mine, True), at(theirs, True).union(at(theirs, False))).union(pairs(at(mine, False), at(theirs, True))).distinct()
    near = met.withColumn("step", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.log(F.greatest(F.col("n"), F.lit(LEAST)).cast("double")) / F.log(F.lit(STEP))) + k)))
    sums = every.where("amount_usd IS NOT NULL").select(F.col("company").alias("other"), F.col("amount_usd").alias("sum"), step.alias("step")).distinct()
    return near.join(sums, ["other", "step"]).where(F.col("sum").between(F.floor(F.col("n") * 0.95), F.floor(F.col("n") * 1.05))).select(F.col("company").alias("a"), F.col("other").alias("b")).distinct()


def _rows(df: DataFrame, is_new: bool | None) -> DataFrame:
    """Rows of the fold; ``is_new`` is a column where it is None."""
    only = lambda name, kind: F.lit(None).cast(kind) if is_new is False else F.col(name)
    flag = F.col("is_new") if is_new is None else F.lit(is_new)
    return df.select(
        "block", flag.alias("is_new"), only("seq", "long").alias("seq"), F.col("deal_id").cast("long").alias("deal_id"), "name", names.stripped(F.lower("name")).alias("low"), "norm", "round_type", "amount", F.col("amount_usd").cast("long").alias("amount_usd"),
        "amount_source", F.unix_date("announced_date").alias("day"), F.coalesce(dates.is_placeholder(F.col("announced_date")), F.lit(False)).alias("placeholder"), F.col("date_confidence").cast("double").alias("date_confidence"), F.col("date_source_count").cast("long").alias("date_source_count"),
        F.unix_date("created_date").alias("created"), amounts.is_real(F.col("amount")).alias("real"), F.coalesce(only("filed", "boolean"), F.lit(False)).alias("filed"), "dedup_key", "amount_key", only("adjacent", "array<string>").alias("adjacent"),
    )


def save(stored: DataFrame, incoming: DataFrame, as_of: datetime.date) -> tuple[DataFrame, DataFrame]:
    """The stored deals afterwards, and the outcome of every new one: ``seq, outcome, tier, deal_id``.

    Outcomes: ``merged`` (and the ``tier``), ``amount key``, ``adjacent key``, ``key``, ``inserted``.
    """
    new = written(_parsed(incoming, as_of).withColumn("company", company_key(F.col("norm"))), "save-new")
    old = stored.select(*STORED).withColumn("company", company_key(F.col("norm")))
    groups = linked_groups(company_links(old, new)).select(F.col("key").alias("company"), "least")
    blocked = lambda df: df.join(groups, "company", "left").withColumn("block", F.coalesce("least", "company"))
    new = blocked(new)
    old = blocked(old).join(new.select("block").distinct(), "block", "left_semi")
    come = [*STORED, "block", "is_new", "seq", "filed"]
    new = new.withColumns({"is_new": F.lit(True), "dedup_key": F.lit(None).cast("string"), "amount_key": F.lit(None).cast("string")}).select(come)
    old = old.withColumns({"is_new": F.lit(False), "seq": F.lit(None).cast("long"), "filed": F.lit(False)}).select(come)
    rows = old.unionByName(new).repartition("block").sortWithinPartitions("block", "is_new", "seq", "deal_id")
    made = _keyed(rows.withColumnsRenamed({"dedup_key": "_dedup", "amount_key": "_amount"}), as_of)
    mine = lambda key, held=None: F.when(F.col("is_new"), F.col(key)).otherwise(held).alias(key)
    rows = made.withColumns({"dedup_key": mine("dedup_key", F.col("_dedup")), "amount_key": mine("amount_key", F.col("_amount")), "adjacent": mine("adjacent")})
    rows = _rows(rows, None)
    today = (as_of - datetime.date(1970, 1, 1)).days
    told = written(rows.mapInArrow(lambda batches: fold.folded(batches, today), fold.OUT_DDL), "save-told")
    dated = {"announced_date": F.date_from_unix_date("day"), "created_date": F.date_from_unix_date("created")}
    changed = told.where("kind = 'deal'").withColumns(dated).select(*STORED)
    deals = stored.select(*STORED).join(changed.select("deal_id"), "deal_id", "left_anti").unionByName(changed)
    return deals, told.where("kind = 'outcome'").select("seq", "outcome", "tier", "deal_id")
