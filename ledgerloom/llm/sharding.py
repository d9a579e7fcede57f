"""Sharding (operator 9) by balanced label propagation, in DataFrame operations alone.

Documents with equal texts are linked; every document carries the size of its text and one byte.  For the joins, the rows
of a text are first gathered into at most ``SALTS`` units, so that a text that a third of all rows share is still spread.
Units start in shards by hash.  In each round every unit looks at the shards of its neighbours, the units of its text,
and asks to move to the one that holds most of their bytes; a shard takes as much as its capacity and the moves away from
it leave room for, texts of few bytes first, since each of them saves as many cuts for less.  After these rounds a text
is in one shard, unless it alone is larger than a shard.  Then shards above the mean pass whole texts (units of texts that
are cut already) to those below it, each round only texts smaller than what is still uneven, until sizes are even.

Requests are ranked by ``BUCKETS`` hash buckets: per shard and bucket sums, running totals over them and the verdict are
tables of a size that depends on the numbers of shards and buckets alone; all else is joins and aggregations by text.

Defined results: law is ``bytes``; a null text has no bytes, size 1, and is linked with other null and empty texts;
repeated rows are linked like other copies and get slots of their own; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import staged

SHARDS = 8
SALTS = 64
BUCKETS = 1024
#: Of the mean size, how far a shard may exceed it while texts are drawn together.
SLACK = 0.25
#: Of the mean size; below it shards count as even.
EVEN = 0.0005
PULL_ROUNDS = 4
EVEN_ROUNDS = 8



def _running(shard: str):
    """All buckets of a shard up to this one."""
    return Window.partitionBy(shard).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)


def _hash(*columns: str, of: int):
    return F.pmod(F.xxhash64(*columns), F.lit(of)).cast("int")


def _loads(units: DataFrame, shards: int) -> DataFrame:
    """``shard, load`` of all shards, empty ones too."""
    every = units.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return every.join(units.groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left").select("shard", F.coalesce("load", F.lit(0)).alias("load"))


def pull_together(units: DataFrame, capacity: float, shards: int) -> DataFrame:
    """One round: units (``text, salt, bytes, shard``) move to the shard where their text has most bytes, if it has room."""
    by_shard = units.groupBy("text", "shard").agg(F.sum("bytes").alias("b"))
    pull = by_shard.groupBy("text").agg(F.max_by("shard", F.struct("b", -F.col("shard"))).alias("to"), F.sum("b").alias("whole"), F.count("*").alias("places")).where("places > 1")
    # a text too large to move at once is ranked unit by unit
    rank = F.when(F.col("whole") > capacity / 4, _hash("text", "salt", of=16)).otherwise(_hash("text", of=16))
    asks = units.join(pull, "text").where("shard != to").select("text", "salt", "bytes", "shard", "to", (F.least(F.lit(BUCKETS // 16 - 1), F.floor(F.log2(F.col("whole") + 1))).cast("int") * 16 + rank).alias("bucket"))
    asks = staged(asks, "sharding-asks")
    leaving = asks.groupBy("shard").agg(F.sum("bytes").alias("leaves"))
    room = _loads(units, shards).join(leaving, "shard", "left").select(F.col("shard").alias("to"), (capacity - F.col("load") + F.coalesce("leaves", F.lit(0))).alias("room"))
    totals = asks.groupBy("to", "bucket").agg(F.sum("bytes").alias("b")).withColumn("running", F.sum("b").over(_running("to")))
    granted = totals.join(F.broadcast(room), "to").where("running <= room").select("to", "bucket")
    moves = asks.join(F.broadcast(granted), ["to", "bucket"]).select("text", "salt", "to")
    moved = units.join(moves, ["text", "salt"], "left")
    return staged(moved.select("text", "salt", "bytes", F.coalesce("to", "shard").alias("shard")), "sharding-units")


def even_out(units: DataFrame, mean: float, shards: int, turn: int) -> DataFrame:
    """One round: shards above the mean pass on texts, no larger than what is uneven, to shards below it."""
    balance = _loads(units, shards).select("shard", (F.col("load") - mean).alias("over"))
    order = Window.orderBy("shard")  # over the shards
    below = balance.where("over < 0").select("shard", (-F.col("over")).alias("room")).withColumn("till", F.sum("room").over(order)).select(F.col("shard").alias("to"), (F.col("till") - F.col("room")).alias("from_"), "till")

    places = units.groupBy("text").agg(F.count_distinct("shard").alias("places"))
    # what moves as one: a text that is whole, or a unit of one that isn't
    pieces = units.join(places, "text").withColumn("piece", F.when(F.col("places") > 1, F.col("salt")).otherwise(F.lit(-1)))
    sizes = pieces.groupBy("text", "piece", "shard").agg(F.sum("bytes").alias("b"))
    above = balance.where("over > 0")
    fit = sizes.join(F.broadcast(above), "shard").where(F.col("b") <= F.col("over"))
    fit = fit.withColumn("bucket", F.pmod(F.xxhash64("text", "piece", F.lit(turn)), F.lit(BUCKETS)).cast("int"))
    fit = staged(fit.select("text", "piece", "shard", "b", "over", "bucket"), "sharding-fit")
    totals = fit.groupBy("shard", "bucket").agg(F.sum("b").alias("b"), F.first("over").alias("over"))
    leave = totals.withColumn("running", F.sum("b").over(_running("shard"))).where("running <= over")
    line = Window.orderBy("shard", "bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most shards x buckets rows
    leave = leave.withColumn("at", F.sum("b").over(line) - F.col("b") / 2)
    to = leave.join(F.broadcast(below), (F.col("at") >= F.col("from_")) & (F.col("at") < F.col("till"))).select("shard", "bucket", "to")
    moves = fit.join(F.broadcast(to), ["shard", "bucket"]).select("text", "piece", "shard", "to")
    moved = pieces.join(moves, ["text", "piece", "shard"], "left")
    return staged(moved.select("text", "salt", "bytes", F.coalesce("to", "shard").alias("shard")), "sharding-units")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("text"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    rows = staged(rows, "sharding-rows")
    units = rows.groupBy("text", "salt").agg(F.sum("size").alias("bytes")).withColumn("shard", _hash("text", "salt", of=shards))
    units = staged(units, "sharding-units")
    total = units.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).collect()[0]["b"]
    mean = total / shards
    for _ in range(PULL_ROUNDS):
        units = pull_together(units, mean * (1 + SLACK), shards)
    for turn in range(EVEN_ROUNDS):
        most = _loads(units, shards).agg(F.max(F.abs(F.col("load") - mean)).alias("m")).collect()[0]["m"]
        if most <= mean * EVEN:
            break
        units = even_out(units, mean, shards, turn)

    placed = rows.join(units.select("text", "salt", "shard"), ["text", "salt"])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(BUCKETS // 4)).cast("int")).select("doc_id", "size", "text_crc32", "shard", "part")
    placed = staged(placed, "sharding-placed")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")) - 1
    numbered = placed.withColumn("within", within).join(F.broadcast(before), ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
