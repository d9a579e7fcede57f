"""Lists that are served in pages, and changes of stored tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filtered_deals(
    deals: DataFrame, investors: DataFrame, *, round_type: str | None = None, led: bool | None = None, is_ai: bool | None = None, is_enterprise: bool | None = None, category: str | None = None,
    fund: str | None = None, name: str | None = None,
) -> DataFrame:
    """Deals (with ``name``) that pass the given filters; ``investors``: deal_id, slug, is_lead, is_tracked_fund.

    ``led`` keeps deals that a tracked fund leads, or those that none does; ``fund`` those that it takes part in.
    """
    out = deals
    for column, value in (("round_type", round_type), ("is_ai_deal", is_ai), ("is_enterprise_ai", is_enterprise), ("enterprise_category", category)):
        if value is not None:
            out = out.where(F.col(column) == value)
    if led is not None:
        leads = investors.where("is_lead AND is_tracked_fund").select("deal_id")
        out = out.join(leads, "deal_id", "left_semi" if led else "left_anti")
    if fund is not None:
        out = out.join(investors.where(F.col("slug") == fund).select("deal_id"), "deal_id", "left_semi")
    return out if name is None else out.where(F.col("name").ilike(f"%{name}%"))


def deals_page(deals: DataFrame, offset: int, limit: int, descending: bool = True) -> DataFrame:
    """A page in order of dates, with the number of deals in all and whether more follow."""
    date, created = ("desc_nulls_last", "desc") if descending else ("asc_nulls_first", "asc")
    ordered = deals.orderBy(getattr(F, date)("announced_date"), getattr(F, created)("created_date"), "deal_id").offset(offset).limit(limit)
    total = deals.agg(F.count("*").alias("total"))
    return ordered.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # the total is one row


def without_deals(tables: dict[str, DataFrame], gone: DataFrame, unlinked: dict[str, str]) -> dict[str, DataFrame]:
    """Tables after deals (``gone``: deal_id) are deleted: their rows go with them, but in ``unlinked`` tables only the link does."""
    out = {name: t.join(gone, "deal_id", "left_anti") for name, t in tables.items() if name not in unlinked}
    marked = gone.select("deal_id").distinct().withColumn("_gone", F.lit(True))
    for name, column in unlinked.items():
        t = tables[name].join(marked.withColumnRenamed("deal_id", column), column, "left")
        out[name] = t.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone").select(*tables[name].columns)
    return out


def upserted_detections(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``detected_url, fund_slug, company_name, notes``: by address, what is stored stays, and its gaps are filled in order of ``seq``."""
    rows = stored.select("detected_url", "fund_slug", "company_name", "notes", F.lit(-1).cast("long").alias("seq")).unionByName(new.select("detected_url", "fund_slug", "company_name", "notes", "seq"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy("detected_url").agg(F.min_by("fund_slug", "seq").alias("fund_slug"), first("company_name"), first("notes"))


def latest_snapshots(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``fund_slug, names`` with the funds' newest snapshots in place of stored ones."""
    return stored.join(new, "fund_slug", "left_anti").unionByName(new)


def usage_batches(entries: DataFrame, size: int) -> DataFrame:
    """Entries (``seq``) with the number of the append that takes them: a full buffer is written, the rest by force at the end.

    Each partition of the sequence numbers its entries after those before it, so that no task sees them all.
    """
    spread = entries.repartitionByRange("seq").withColumn("_part", F.spark_partition_id())
    before = spread.groupBy("_part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "before")  # a row for each partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy("seq")) - 1
    return spread.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn("batch", F.floor((F.col("before") + F.col("_within")) / size)).drop("_part", "_within", "before")


# Kinds of aliases.
ALIAS_KINDS = ("rebrand", "dba", "acquired_name", "typo")


def with_aliases(stored: DataFrame, new: DataFrame, kinds: tuple[str, ...] = ALIAS_KINDS) -> DataFrame:
    """``company_id, alias_name, kind`` after new ones: only of known kinds, and none whose name, whatever its case, is stored."""
    key = F.lower(F.trim("alias_name"))
    valid = new.where(F.col("kind").isin(*kinds) & (F.trim("alias_name") != "")).withColumn("_key", key)
    fresh = valid.join(stored.select(key.alias("_key")), "_key", "left_anti")
    first = fresh.groupBy("_key").agg(F.min(F.struct("company_id", "alias_name", "kind")).alias("a")).select("a.*")
    return stored.unionByName(first)


def unique_slugs(rows: DataFrame, key: str = "slug", order: str = "id") -> DataFrame:
    """Slugs of their own: the second of the same name gets ``_1``, the third ``_2``, and so on."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return rows.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 0, F.concat(key, F.lit("_"), F.col("_n").cast("string"))).otherwise(F.col(key))).drop("_n")


def next_positions(stored: DataFrame, new: DataFrame, group: str = "status", order: str = "item_id") -> DataFrame:
    """New items with positions after the last stored one of their group."""
    last = stored.groupBy(group).agg(F.max("position").alias("_last"))
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return new.withColumn("_n", n).join(last, group, "left").withColumn("position", (F.coalesce("_last", F.lit(-1)) + F.col("_n")).cast("long")).drop("_n", "_last")


def live(cache: DataFrame, now: datetime.datetime, days: int = 30) -> DataFrame:
    """Entries of a cache (``stored_at``) that haven't expired."""
    return cache.where(F.col("stored_at") > F.lit(now - datetime.timedelta(days=days)))


def served_positions(now: DataFrame, last: DataFrame, failed: bool) -> DataFrame:
    """The positions of a poll, or those of the last good one if it failed."""
    return last if failed else now


def not_repeated(texts: DataFrame, longer: float = 2.0) -> DataFrame:
    """Texts of a run (``seq, content_hash, n_chars``) but those whose hash came before, unless they are so many times longer than the last that stayed.

    The run of a hash is folded in order; its lengths are an array of longs, not the texts.
    """
    runs = texts.groupBy("content_hash").agg(F.sort_array(F.collect_list(F.struct("seq", "n_chars"))).alias("run"))

    def step(state, x):
        fresh = state["last"].isNull() | (x["n_chars"] > longer * state["last"])
        return F.struct(F.when(fresh, x["n_chars"]).otherwise(state["last"]).alias("last"), F.when(fresh, F.concat(state["kept"], F.array(x["seq"]))).otherwise(state["kept"]).alias("kept"))

    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("kept"))
    kept = runs.select(F.explode(F.aggregate("run", start, step, lambda s: s["kept"])).alias("seq"))
    return texts.join(kept, "seq", "left_semi")


def merged_by_priority(rows: DataFrame, key: str, rank: list[str]) -> DataFrame:
    """The first row of each key by rank."""
    order = F.struct(*rank)
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r"))
    return first.select(key, "_r.*")


# Fields of tracker items that may be changed; the status has a way of its own.
TRACKER_FIELDS = ["company_name", "round_type", "amount", "lead_investor", "website", "notes", "last_contact_date", "next_step"]


def updated_items(items: DataFrame, changes: DataFrame) -> DataFrame:
    """Tracker items with the changes (``item_id, field, value``, the last by ``seq``) of the fields that may change."""
    allowed = changes.where(F.col("field").isin([f for f in TRACKER_FIELDS if f in items.columns]))
    last = allowed.groupBy("item_id").pivot("field", [f for f in TRACKER_FIELDS if f in items.columns]).agg(F.max_by(F.struct("value"), "seq"))
    fields = [f for f in TRACKER_FIELDS if f in items.columns]
    named = last.select("item_id", *[F.col(f).alias(f"_{f}") for f in fields])
    out = items.join(named, "item_id", "left")
    return out.withColumns({f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value")).otherwise(F.col(f)) for f in fields}).select(*items.columns)


def with_funds(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Funds (``slug, fund_name``) with those of ``wanted`` that weren't there, once each."""
    new = wanted.join(stored, "slug", "left_anti").groupBy("slug").agg(F.min("fund_name").alias("fund_name"))
    return stored.select("slug", "fund_name").unionByName(new)
