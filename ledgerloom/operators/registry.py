"""Filings against registry entities, feeds' circuit breakers, aliases."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.names import stripped

#: Lengths of the parts of names that are looked up; each is at most half as long again as the one before.
PARTS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)


def _part_length(name: Column) -> Column:
    """The longest of ``PARTS`` that a name has room for; an empty name has none."""
    return F.array_max(F.filter(F.array(*map(F.lit, PARTS)), lambda n: n <= F.length(name)))


def _parts(name: Column, lengths: Column) -> Column:
    """All parts of a name of each of some lengths, each once."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda k: F.substring(name, k, n))
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(name)), of)))


def _every(names: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """Parts of the names of all lengths that are looked up; ``wanted`` is one row, of at most as many lengths as ``PARTS``."""
    lengths = wanted.agg(F.collect_set("n").alias("_lengths"))
    return names.crossJoin(F.broadcast(lengths)).withColumn("part", F.explode(_parts(F.col(name), F.col("_lengths")))).drop("_lengths")


def _rarest(wanted: DataFrame, name: str, counts: DataFrame) -> DataFrame:
    """The rarest of each name's parts, unless one of them is nowhere: then nothing holds the name."""
    parts = wanted.where(F.length(name) > F.col("n")).select(name, F.explode(_parts(F.col(name), F.array("n"))).alias("part"))
    seen = parts.join(counts.select("part", "often"), "part", "left").groupBy(name).agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "part")).alias("p"))
    return seen.where("p.often > 0").select(name, "p.part")


def held_matches(one: DataFrame, two: DataFrame) -> DataFrame:
    """``a, entity_id``: the first entity that holds a name, and all that it holds; ``one``: a; ``two``: b, entity_id; all distinct.

    Whatever holds a name holds all its parts.  A name of one of the lengths ``PARTS`` is such a part itself, and meets the
    first entity of those that have it, a row for each part.  A longer one is looked up by the rarest of its parts of the
    longest such length, two thirds of it or more, so that what it meets is near to what holds it, however many names there are.
    """
    a, b = (names.select("*", _part_length(F.col(c)).alias("n")).where("n IS NOT NULL") for names, c in ((one, "a"), (two, "b")))
    in_b, in_a = _every(two, "b", a.select("n")), _every(one, "a", b.select("n"))
    of_b = in_b.groupBy("part").agg(F.count("*").alias("often"), F.min("entity_id").alias("entity_id"))
    of_a = in_a.groupBy("part").agg(F.count("*").alias("often"))
    is_part = lambda c: F.length(c) == F.col("n")
    found = [
        a.where(is_part("a")).join(of_b, F.col("a") == F.col("part")).select("a", "entity_id"),
        _rarest(a, "a", of_b).join(in_b, "part").where(F.col("b").contains(F.col("a"))).select("a", "entity_id"),
        b.where(is_part("b")).join(in_a, F.col("b") == F.col("part")).select("a", "entity_id"),
        _rarest(b, "b", of_a).join(b.select("b", "entity_id"), "b").join(in_a, "part").where(F.col("a").contains(F.col("b"))).select("a", "entity_id"),
    ]
    return functools.reduce(DataFrame.unionByName, found)


def _pairs_of(words: Column) -> Column:
    """All pairs of a name's words, in order."""
    ordered = F.array_sort(words)
    return F.flatten(F.transform(ordered, lambda w, i: F.transform(F.slice(ordered, i + 2, F.size(ordered)), lambda x: F.concat(w, F.lit(" "), x))))


def match_entities(filings: DataFrame, entities: DataFrame) -> DataFrame:
    """``filing_id, entity_id``: the first entity whose name holds the filing's, or is held, or shares two words (all of fewer).

    ``filings``: filing_id, company; ``entities``: entity_id, entity.  Different names meet once: by parts (``held_matches``), and
    by words and pairs of words, each of which leads to the first entity that has it.  A name that is nothing but a legal
    form matches none.
    """
    bare = F.trim(F.regexp_replace(F.col("company"), r"(?i)\s*(Inc\.?|LLC|Corp\.?|Corporation|Ltd\.?)$", ""))
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    f = filings.select("filing_id", F.lower(bare).alias("a")).where("a <> ''")
    one = f.select("a").distinct()
    two = entities.groupBy(F.lower("entity").alias("b")).agg(F.min("entity_id").alias("entity_id")).where("b <> ''")

    of_b = two.select("entity_id", words(F.col("b")).alias("w"))
    first = lambda keys: of_b.select("entity_id", F.explode(keys).alias("key")).groupBy("key").agg(F.min("entity_id").alias("entity_id"))
    of_a = one.select("a", words(F.col("a")).alias("w"))
    single = of_a.where("size(w) = 1").select("a", F.col("w")[0].alias("key")).join(first(F.col("w")), "key")
    double = of_a.where("size(w) > 1").select("a", F.explode(_pairs_of(F.col("w"))).alias("key")).join(first(_pairs_of(F.col("w"))), "key")
    found = held_matches(one, two).unionByName(single.select("a", "entity_id")).unionByName(double.select("a", "entity_id"))
    return f.join(found.groupBy("a").agg(F.min("entity_id").alias("entity_id")), "a").select("filing_id", "entity_id")


def tripped(runs: DataFrame, most: int) -> DataFrame:
    """Runs (``source, seq, failed``) that a breaker would skip: ``most`` failures in a row came before them."""
    order = Window.partitionBy("source").orderBy("seq")
    good = F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    streak = Window.partitionBy("source", "good").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("good", F.coalesce(good, F.lit(0))).withColumn("streak", F.coalesce(F.sum(F.col("failed").cast("int")).over(streak), F.lit(0))).where(F.col("streak") >= most).drop("good", "streak")


def by_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``names`` (``name``) with the company (``company_id``) that has the name as an alias (``alias_name``), whatever its case."""
    known = aliases.groupBy(F.lower(stripped(F.col("alias_name"))).alias("key")).agg(F.min("company_id").alias("company_id"))
    return names.withColumn("key", F.lower(stripped(F.col("name")))).join(known, "key", "left").drop("key")
