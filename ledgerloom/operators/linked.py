"""Groups of keys that links hold together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.written import written


def linked_groups(links: DataFrame) -> DataFrame:
    """``key, least`` for every key of ``links`` (``a, b``): the least key that links lead to.

    Links are drawn towards least neighbours from above and from below in turn, so that paths shorten by half and the
    turns grow with the logarithm of the longest path; every turn is two groupings and two joins, and ends in a table.
    """
    found = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        both = found.union(found.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        above = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        below = above.groupBy("a").agg(F.min("b").alias("m"))
        next_links = above.join(below, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(below).where("a != b").distinct()
        found = written(next_links, "links")
        now = found.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == mark:
            return found.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("least"))
        mark = now
