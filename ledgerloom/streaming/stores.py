"""Tables and states that streams keep: upserts by key, appends that survive a failed write, versions of a poll, silent scans, seen contents."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.written import written

Combine = Callable[[DataFrame, DataFrame], DataFrame]


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in any store that Spark reads."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(s.getPath().toString()) for s in found or [])


# ---- upserts --------------------------------------------------------------------------------------------------------
def upsert(path: str, batch: DataFrame, batch_id: int, key: str, combine: Combine, buckets: int = 64) -> None:
    """Combine a batch with the rows of its keys in the table at ``path``, in place.

    The table is partitioned by a hash of the key.  Only the buckets that the batch touches are read and written again; the
    files of all others stay.  A bucket remembers the last batch that it took (``_batch``), so a batch that comes again, whole
    or after a failure that left some of its buckets behind, changes only those that miss it.  ``combine(stored, new)`` gives
    the rows of the touched buckets afterwards.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    new = written(batch.withColumn("_bucket", bucket), "upsert-batch")
    old = spark.read.parquet(path) if _paths(spark, f"{path}/_bucket=*") else spark.createDataFrame([], new.schema).withColumn("_batch", F.lit(0).cast("long"))
    done = old.groupBy("_bucket").agg(F.max("_batch").alias("_last")).where(F.col("_last") >= batch_id)  # a row for each bucket
    new = new.join(F.broadcast(done), "_bucket", "left_anti")
    touched = new.select("_bucket").distinct()
    columns = [c for c in batch.columns]
    stored = old.join(F.broadcast(touched), "_bucket", "left_semi").select(*columns)
    after = combine(stored, new.select(*columns)).select(*columns).withColumns({"_batch": F.lit(batch_id).cast("long"), "_bucket": bucket})
    after = written(after.repartition("_bucket"), "upsert-after")  # before any file of the table goes
    after.write.partitionBy("_bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that ``upsert`` keeps."""
    return spark.read.parquet(path).drop("_bucket", "_batch")


def upserting(stream: DataFrame, path: str, checkpoint: str, key: str, combine: Combine, buckets: int = 64):
    """A started query that upserts each micro-batch of a stream."""
    return stream.writeStream.foreachBatch(lambda batch, n: upsert(path, batch, n + 1, key, combine, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- appends --------------------------------------------------------------------------------------------------------
def append_batch(batch: DataFrame, number: int, path: str) -> None:
    """A micro-batch as a folder of its own, so that one written twice is there once."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def append_all(stream: DataFrame, path: str, checkpoint: str, attempts: int = 3, write: Callable[[DataFrame, int, str], None] = append_batch) -> int:
    """Append what a stream holds; a batch whose write fails is queued again, as the checkpoint hasn't passed it.

    Gives how many attempts it took.  The stream's own options (files or bytes a trigger) say when a buffer is full.
    """
    for attempt in range(1, attempts + 1):
        query = stream.writeStream.foreachBatch(lambda batch, n: write(batch, n, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
            return attempt
        except StreamingQueryException:
            if attempt == attempts:
                raise
    return attempts


# ---- versions -------------------------------------------------------------------------------------------------------
def publish(rows: DataFrame, folder: str, version: int) -> None:
    """A poll's rows as a version; it counts once its write is committed, until then the one before is served."""
    rows.write.mode("overwrite").parquet(f"{folder}/version={version:012d}")


def served(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last version whose write was committed; None if there is none."""
    done = _paths(spark, f"{folder}/version=*/_SUCCESS")
    return spark.read.parquet(done[-1].rsplit("/", 1)[0]) if done else None


# ---- silent scans ---------------------------------------------------------------------------------------------------
def silent_scans(beats: DataFrame, silence: int = 300, late: str = "0 seconds") -> DataFrame:
    """``scan_id, since``: each running scan once, when ``silence`` seconds of event time pass without a heartbeat.

    ``beats``: scan_id, status, ts.  A timer per scan is set anew by every heartbeat and cleared when the scan isn't running any more.
    """

    def follow(key, batches, state: GroupState):
        if state.hasTimedOut:
            since = state.get[0]
            state.remove()
            yield pd.DataFrame({"scan_id": [key[0]], "since": [pd.Timestamp(since, unit="ms")]})
            return
        last, status = (state.get[0] if state.exists else -1), "running"
        for batch in batches:
            for at, said in zip(batch["ts"].astype("datetime64[ms]").astype("int64"), batch["status"], strict=True):
                if at >= last:
                    last, status = int(at), said
        if status != "running":
            if state.exists:
                state.remove()
        elif last + silence * 1000 <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield pd.DataFrame({"scan_id": [key[0]], "since": [pd.Timestamp(last, unit="ms")]})
        else:
            state.update((last,))
            state.setTimeoutTimestamp(last + silence * 1000)

    marked = beats.withWatermark("ts", late).groupBy("scan_id")
    return marked.applyInPandasWithState(follow, "scan_id bigint, since timestamp_ntz", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


# ---- contents that were seen ----------------------------------------------------------------------------------------
class ContentCache:
    """Lengths of contents by hash, at most ``most``: where a new one finds it full, the oldest tenth by insertion goes."""

    def __init__(self, most: int, entries: dict[str, int] | None = None):
        self.most, self.entries = most, dict(entries or {})

    def is_fresh(self, content_hash: str, length: int, longer: float) -> bool:
        """Whether a content is new, or so many times longer than what is known; it is remembered then, in its old place if it has one."""
        known = self.entries.get(content_hash)
        if known is not None and length <= longer * known:
            return False
        if known is None and len(self.entries) >= self.most:
            for old in list(self.entries)[: max(1, self.most // 10)]:
                del self.entries[old]
        self.entries[content_hash] = length
        return True


def fresh_contents(texts: DataFrame, most: int = 10_000, shards: int = 1, longer: float = 2.0, idle: str = "30 days") -> DataFrame:
    """``seq, content_hash, n_chars`` of a stream's contents that weren't seen before, by a cache of bounded size.

    ``texts``: seq, ts, content_hash, n_chars; those of a micro-batch are taken in order of ``seq``.  Contents are dealt over
    ``shards`` caches of ``most / shards`` each, so that many tasks keep them; one shard evicts in the order of the whole stream.
    A shard without texts for ``idle`` of event time is forgotten.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def sift(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        cache = ContentCache(max(1, most // shards), dict(zip(*state.get, strict=True)) if state.exists else None)
        kept = [cache.is_fresh(h, int(n), longer) for h, n in zip(rows["content_hash"], rows["n_chars"], strict=True)]
        state.update((list(cache.entries), list(cache.entries.values())))
        last = int(rows["ts"].max().value // 1_000_000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        yield rows.loc[kept, ["seq", "content_hash", "n_chars"]]

    shard = F.pmod(F.xxhash64("content_hash"), F.lit(shards)).alias("shard")
    dealt = texts.select("seq", "ts", "content_hash", "n_chars", shard).withWatermark("ts", "0 seconds").groupBy("shard")
    return dealt.applyInPandasWithState(sift, "seq bigint, content_hash string, n_chars bigint", "hashes array<string>, lengths array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
