"""Connected components of a link table by rounds of joins: each node takes the least label near it, labels jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, label`` for all ends of ``links`` (``a, b``): the label is the least node of the component.

    Rounds of "every node tells its neighbours its least neighbour" rewire the links towards least nodes until all links
    are stars; each round is two aggregations, and the links are written after it, so lost executors cost one round.
    """
    edges = common.staged(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "components")
    previous = None
    for _ in range(most_rounds):
        # large star: each node's larger neighbours are linked to its least neighbour
        both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.min("hi").alias("m")).select("lo", F.least("lo", "m").alias("m"))
        least = common.staged(least, "components-least")  # a table, so that the join can split the links of a much linked node
        large = both.join(least, "lo").where(F.col("hi") > F.col("lo")).select(F.col("m").alias("lo"), "hi").distinct()
        # small star: each node's smaller neighbours, and it, are linked to the least of them
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(small_least, "hi").select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi")).where(F.col("lo") != F.col("hi")).distinct()
        before, edges = edges, common.staged(small, "components")
        common.discard(before)
        common.discard(least)
        state = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s")).collect()[0]
        if (state["n"], state["s"]) == previous:
            break
        previous = (state["n"], state["s"])
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
