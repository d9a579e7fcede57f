"""Tables that streams keep: replays, failed writes, versions, timers."""

import datetime
import pathlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import serving
from ledgerloom.streaming import stores

T = datetime.datetime
ROWS = "detected_url string, fund_slug string, company_name string, notes string, seq long"


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("*.parquet")}


def combine(old, new):
    merged = serving.upserted_detections(old, new)
    return merged.withColumn("seq", F.lit(-1).cast("long"))


def content(spark, path):
    return {r["detected_url"]: (r["fund_slug"], r["company_name"], r["notes"]) for r in stores.stored(spark, path).collect()}


def test_upserts_in_place(spark, tmp_path):
    path = str(tmp_path / "detections")
    first = spark.createDataFrame([(f"u{k}", f"fund{k % 3}", None if k % 2 else f"c{k}", None, k) for k in range(60)], ROWS)
    stores.upsert(path, first, 1, "detected_url", combine, buckets=8)
    assert len(content(spark, path)) == 60 and content(spark, path)["u1"] == ("fund1", None, None)
    before = files(path)
    change = spark.createDataFrame([("u1", "other", "c1", "n", 1), ("new", "fund9", None, None, 2)], ROWS)
    stores.upsert(path, change, 2, "detected_url", combine, buckets=8)
    after, got = files(path), content(spark, path)
    assert len(got) == 61 and got["u1"] == ("fund1", "c1", "n") and got["new"] == ("fund9", None, None)
    assert 0 < len(set(after) - set(before)) <= 2 and all(after[f] == before[f] for f in set(after) & set(before)) and len(set(after) & set(before)) >= 6
    stores.upsert(path, change, 2, "detected_url", combine, buckets=8)  # the same batch once more
    assert files(path) == after and content(spark, path) == got


def test_upserts_of_a_half_written_batch_are_finished(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    whole = spark.createDataFrame([(f"f{k}", [f"n{k}"]) for k in range(40)], "fund_slug string, names array<string>")
    stores.upsert(path, whole, 1, "fund_slug", serving.latest_snapshots, buckets=4)
    change = spark.createDataFrame([(f"f{k}", ["new"]) for k in range(40)], "fund_slug string, names array<string>")
    half = change.where(F.pmod(F.xxhash64("fund_slug"), F.lit(4)) < 2)  # as if the commit had ended after two buckets
    stores.upsert(path, half, 2, "fund_slug", serving.latest_snapshots, buckets=4)
    done = files(path)
    stores.upsert(path, change, 2, "fund_slug", serving.latest_snapshots, buckets=4)
    assert all(r["names"] == ["new"] for r in stores.stored(spark, path).collect()) and stores.stored(spark, path).count() == 40
    assert len(set(files(path)) & set(done)) >= 2


def landed(spark, tmp_path, name, batches, schema):
    source = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source / f"b{k}"))
        for f in (source / f"b{k}").glob("part-*"):
            import os
            import time

            os.utime(f, (time.time() - 1000 + k * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(source))


def test_upserts_of_a_stream(spark, tmp_path):
    stream = landed(spark, tmp_path, "in", [[("a", "f", None, None, 1)], [("a", "g", "name", None, 2), ("b", "g", None, None, 3)]], ROWS)
    path = str(tmp_path / "out")
    for checkpoint in ("one", "two"):  # a lost checkpoint replays the batches under their numbers
        stores.upserting(stream, path, str(tmp_path / checkpoint), "detected_url", combine, buckets=4).awaitTermination(120)
        assert content(spark, path) == {"a": ("f", "name", None), "b": ("g", None, None)}


def test_appends_are_queued_again(spark, tmp_path):
    stream = landed(spark, tmp_path, "usage", [[(k, k * 10)] for k in range(4)], "seq long, tokens long")
    failed = []

    def write(batch, n, path):
        stores.append_batch(batch, n, path)
        if n == 2 and not failed:
            failed.append(n)
            raise OSError("the store went away after it had written")

    out = str(tmp_path / "out")
    assert stores.append_all(stream, out, str(tmp_path / "check"), write=write) == 2 and failed == [2]
    assert sorted((r["seq"], r["tokens"]) for r in spark.read.parquet(out).collect()) == [(k, k * 10) for k in range(4)]

    def never(batch, n, path):
        raise OSError("gone for good")

    with pytest.raises(Exception, match="gone for good"):
        stores.append_all(stream, out, str(tmp_path / "other"), attempts=2, write=never)


def test_a_poll_that_fails_leaves_the_last_one(spark, tmp_path):
    folder = str(tmp_path / "positions")
    assert stores.served(spark, folder) is None
    stores.publish(spark.range(3), folder, 1)
    stores.publish(spark.range(5), folder, 2)
    broken = spark.range(0, 8, 1, 4).select(F.when(F.col("id") < 7, F.col("id")).otherwise(F.raise_error(F.lit("the feed ended"))).alias("id"))
    with pytest.raises(Exception, match="the feed ended"):
        stores.publish(broken, folder, 3)
    assert stores.served(spark, folder).count() == 5
    stores.publish(spark.range(7), folder, 4)
    assert stores.served(spark, folder).count() == 7


def test_silent_scans_are_told_once(spark, tmp_path):
    at = lambda s: T(2026, 1, 1) + datetime.timedelta(seconds=s)
    beats = [
        [(1, "running", at(0)), (2, "running", at(0)), (3, "running", at(0))], [(2, "running", at(200)), (3, "success", at(210))], [(9, "running", at(450))], [(9, "running", at(460))],
        [(9, "running", at(700))], [(9, "running", at(701))], [(1, "running", at(720)), (9, "running", at(990))], [(9, "running", at(1200))], [(9, "running", at(1201))],
    ]
    stream = landed(spark, tmp_path, "beats", beats, "scan_id long, status string, ts timestamp")
    query = stores.silent_scans(stream).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    got = sorted((r["scan_id"], r["since"]) for r in spark.table("silent").collect())
    assert got == [(1, at(0)), (1, at(720)), (2, at(200))]


def plainly_fresh(rows, most, longer):
    """By the letter of the rule, on one list."""
    order, lengths, out = [], {}, []
    for seq, _, content, n in rows:
        if content in lengths and n <= longer * lengths[content]:
            continue
        if content not in lengths:
            if len(lengths) >= most:
                for _ in range(max(1, most // 10)):
                    del lengths[order.pop(0)]
            order.append(content)
        lengths[content] = n
        out.append((seq, content, n))
    return out


def test_cache_of_contents_is_bounded(spark, tmp_path):
    import random

    r = random.Random(3)
    rows = [(k, T(2026, 1, 1) + datetime.timedelta(seconds=k), f"h{int(r.triangular(0, 90, 0))}", r.choice([50, 60, 120, 400])) for k in range(600)]
    schema = "seq long, ts timestamp, content_hash string, n_chars long"
    stream = landed(spark, tmp_path, "texts", [rows[:250], rows[250:251], rows[251:]], schema)
    for name, most in (("small", 20), ("large", 1000)):
        query = stores.fresh_contents(stream, most=most).writeStream.format("memory").queryName(f"fresh_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(200)
        got = sorted((x["seq"], x["content_hash"], x["n_chars"]) for x in spark.table(f"fresh_{name}").collect())
        assert got == plainly_fresh(rows, most, 2.0)
    query = stores.fresh_contents(stream, most=1000, shards=4).writeStream.format("memory").queryName("fresh_dealt").outputMode("append").option("checkpointLocation", str(tmp_path / "dealt")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert sorted(x["seq"] for x in spark.table("fresh_dealt").collect()) == [s for s, *_ in plainly_fresh(rows, 1000, 2.0)]
