"""The likeliest filing of each deal over all filings, without comparing all pairs of names.

A pair's score is the likeness of its names (twice the characters in matching blocks over all characters), plus what the
days between the two and the form add.  Characters in matching blocks can't be more than those that both names have, so

    likeness <= 2 * common characters / (length + length) <= 2 * shorter / (shorter + longer)

bounds every pair from counts alone, and those that pass from their longest common subsequence.  A pair is compared only
while its bound reaches the best score known for its deal; that begins with a filing of the very name, if there is one.
Days split the search:

* near: deals of ``SPAN`` days meet filings of these and ``REACH`` days around in blocks, as days add to a score within 90
  only; a name is one row with all its days, so that two names are compared once, however many deals and filings have them,
  and first of all with filings of the very name, after which most deals have the best score there is;
* far: what days don't add to can reach 1.1 at most, and 1.1 by equal names alone.  Deals that know a better score are
  done; the others meet names in bands of lengths that the bound on lengths allows for the score they have.

Within two blocks the bounds of all pairs are small matrices; pairs are compared in order of their bound, the best first,
until no bound reaches what was found.  Near pairs are bounded for each day by what its own filings add, and only those
that reach the score of some day are compared.  Rows that repeat names and days are compared once.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.written import written

#: Names of a block, how many times as many companies meet them near, days of a block of deals, and the step from one band of lengths to the next.
BLOCK = 512
WIDE = 8
SPAN = 360
BAND = 1.1
#: What days (at most so many) and the form add.
NEAR = ((7, 0.3), (30, 0.2), (90, 0.1))
FORM_D = 0.1
REACH = max(days for days, _ in NEAR)
#: What each level of nearness adds, from the widest to the nearest; 0 is beyond all, which isn't near.
_ADDS = np.array([-np.inf, *[add for _, add in reversed(NEAR)]])
_GAPS = np.array([-1, *[days for days, _ in reversed(NEAR)]])
_MOST = 1.0 + max(add for _, add in NEAR) + FORM_D
_NO_DAY = -(1 << 31)
_NO_ID = (1 << 63) - 1
_BINS = 64
_ROUNDING = 1e-9
#: Companies that are bounded at a time, thresholds of counts likewise, filings of a block of companies, places of a name that one machine word has, and lengths from which ``difflib`` knows frequent characters.
_STEP, _COLUMNS, _FILED, _WORD, _POPULAR = 1024, 512, 1 << 17, 63, 200


def counted(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the characters of each name, in bins that several characters may share, and its length."""
    out = np.zeros((len(names), _BINS), np.int32)
    for row, name in zip(out, names, strict=True):
        if name:
            row += np.bincount(np.frombuffer(name.encode("utf-32-le"), np.uint32) % _BINS, minlength=_BINS).astype(np.int32)
    return out.astype(np.uint8 if out.max(initial=0) < 256 else np.int32), np.array([len(n) for n in names], np.float64)


def bounds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The most that the likeness of each pair can be.

    The lesser of two counts is the number of thresholds that both reach, so that products of matrices sum it.
    """
    most = np.minimum(a[0].max(0, initial=0), b[0].max(0, initial=0)).astype(np.int64)
    bins = np.repeat(np.arange(_BINS), most)
    least = np.arange(len(bins)) - np.repeat(np.cumsum(most) - most, most) + 1
    common = np.zeros((len(a[0]), len(b[0])), np.float64)
    for k in range(0, len(bins), _COLUMNS):
        at, t = bins[k : k + _COLUMNS], least[k : k + _COLUMNS]
        common += (a[0][:, at] >= t).astype(np.float32) @ (b[0][:, at] >= t).astype(np.float32).T
    both = a[1][:, None] + b[1][None, :]
    return np.where(both > 0, 2.0 * common / np.maximum(both, 1), 1.0)


def nearness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the days between two dates add; ``_NO_DAY`` is no date."""
    gap = np.abs(a[:, None] - b[None, :])
    out = np.zeros(gap.shape)
    for days, add in reversed(NEAR):
        out[gap <= days] = add
    out[(a == _NO_DAY)[:, None] | (b == _NO_DAY)[None, :]] = 0
    return out


def places(name: str) -> dict[str, int]:
    """For each character, a bit for each place where the name has it."""
    out: dict[str, int] = {}
    for k, c in enumerate(name):
        out[c] = out.get(c, 0) | 1 << k
    return out


def common_in_order(where: dict[str, int], length: int, other: str) -> int:
    """Length of the longest common subsequence of a name, given by its ``places``, and another: one integer has a bit for each place."""
    every = open_places = (1 << length) - 1
    for c in other:
        met = open_places & where.get(c, 0)
        open_places = (open_places + met | open_places - met) & every
    return length - open_places.bit_count()


def matched(a: str, b: str) -> int:
    """Characters in matching blocks: the longest, the first of several in ``a`` and then in ``b``, and those before and after it."""
    size = at = 0
    for k in range(len(a)):
        if len(a) - k <= size:
            break
        while k + size < len(a) and a[k : k + size + 1] in b:
            size, at = size + 1, k
    if not size:
        return 0
    other = b.index(a[at : at + size])
    return size + matched(a[:at], b[:other]) + matched(a[at + size :], b[other + size :])


def likeness(name: str, company: str) -> float:
    """The ratio of ``difflib``, which leaves out frequent characters of companies from ``_POPULAR`` on."""
    if max(len(name), len(company)) >= _POPULAR:
        return difflib.SequenceMatcher(None, name, company).ratio()
    both = len(name) + len(company)
    return 2.0 * matched(name, company) / both if both else 1.0


class Companies:
    """Names as columns of characters, against which a name's longest common subsequences are found for all at once."""

    def __init__(self, names: list[str]):
        self.names, self.sizes = names, np.array([len(n) for n in names], np.int64)
        points = [np.frombuffer(n[:_STEP].encode("utf-32-le", "surrogatepass"), np.uint32) for n in names]
        self.alphabet = np.unique(np.concatenate(points)) if points else np.zeros(0, np.uint32)
        self.codes = np.full((max((len(p) for p in points), default=0), len(names)), len(self.alphabet), np.int32)
        for k, p in enumerate(points):
            self.codes[: len(p), k] = np.searchsorted(self.alphabet, p)

    def in_order(self, name: str, some: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of a name and some of the companies."""
        where = places(name)
        if len(name) > _WORD:
            return np.array([common_in_order(where, len(name), self.names[k]) for k in some.tolist()], np.int64)
        bits = np.zeros(len(self.alphabet) + 1, np.uint64)
        for c, at in where.items():
            k = np.searchsorted(self.alphabet, ord(c))
            if k < len(self.alphabet) and self.alphabet[k] == ord(c):
                bits[k] = at
        every = np.uint64((1 << len(name)) - 1)
        open_places = np.full(len(some), every)
        for column in self.codes[: self.sizes[some].max(initial=0), some]:
            met = open_places & bits[column]
            open_places = open_places + met | open_places - met  # what is carried beyond the name's places never comes back
        out = len(name) - np.bitwise_count(open_places & every).astype(np.int64)
        for k in np.flatnonzero(self.sizes[some] > _STEP).tolist():
            out[k] = common_in_order(where, len(name), self.names[some[k]])
        return out


def best_of(names: list[str], days: np.ndarray, known: np.ndarray, companies: list[str], filed: np.ndarray, form: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int, float, float]]:
    """``row, filing, likeness, score`` of the best filing of each name that reaches the score known for it.

    Matching blocks stand in the same order in both names, so a pair whose counts allow it is held against its longest common
    subsequence before it is compared.
    """
    every = bounds(counted(names), counted(companies))
    for first in range(0, len(names), 64):
        part = slice(first, first + 64)
        most = every[part]
        near = nearness(days[part], filed)
        reach = (most + near) + form
        for row in np.flatnonzero((reach >= known[part, None] - _ROUNDING).any(1)).tolist():
            name, best, found = names[first + row], known[first + row], None
            where = places(name)
            rest = np.flatnonzero(reach[row] >= best - _ROUNDING)
            for k in rest[np.lexsort((ids[rest], -reach[row, rest]))].tolist():
                if reach[row, k] < best - _ROUNDING:
                    break
                company, add = companies[k], (near[row, k], form[k])
                both = len(name) + len(company)
                if both and 2 * common_in_order(where, len(name), company) / both + add[0] + add[1] < best - _ROUNDING:
                    continue
                alike = likeness(name, company)
                score = float((alike + add[0]) + add[1])
                if score > best or score == best and (found is None or ids[k] < found[1]):
                    best, found = score, (first + row, int(ids[k]), alike, score)
            if found:
                yield found


def levels(owner: np.ndarray, filed: np.ndarray, companies: int, days: int) -> np.ndarray:
    """For each company and each of so many days from 0 the level of its nearest filing; filings are given by company and day."""
    out = np.zeros((companies, days), np.int8)
    for level in range(1, len(_ADDS)):
        turns = np.zeros((companies, days + 1), np.int32)
        np.add.at(turns, (owner, np.clip(filed - _GAPS[level], 0, days)), 1)
        np.add.at(turns, (owner, np.clip(filed + _GAPS[level] + 1, 0, days)), -1)
        out[np.cumsum(turns[:, :-1], 1, dtype=np.int32) > 0] = level
    return out


class Found:
    """The best filing of each day of a name so far; ``known`` is the score that it has to reach."""

    def __init__(self, days: np.ndarray, known: np.ndarray):
        self.days, self.best = days, known.copy()
        self.ids, self.alike = np.full(len(days), _NO_ID), np.zeros(len(days))

    def take(self, likeness: float, form: float, at: np.ndarray, level: np.ndarray, filed: np.ndarray, ids: np.ndarray) -> None:
        """Filings of one company, given their ``level`` for the days ``at``: the least id of those at the level counts."""
        score = (likeness + _ADDS[level]) + form
        reached = score >= self.best[at]
        if reached.any():
            at, level, score = at[reached], level[reached], score[reached]
            gap = np.abs(self.days[at, None] - filed[None, :])
            least = np.where(gap <= _GAPS[level, None], ids[None, :], _NO_ID).min(1)
            take = (score > self.best[at]) | (least < self.ids[at])
            at = at[take]
            self.best[at], self.ids[at], self.alike[at] = score[take], least[take], likeness

    def rows(self, name: str, first: int) -> list[tuple]:
        return [(name, int(self.days[k]) + first, int(self.ids[k]), float(self.alike[k]), float(self.best[k])) for k in np.flatnonzero(self.ids != _NO_ID).tolist()]


def best_near(names: list[str], days: list[np.ndarray], known: list[np.ndarray], first: int, companies: list[str], filed: list[np.ndarray], form: np.ndarray, ids: list[np.ndarray]) -> Iterator[list[tuple]]:
    """``name, day, filing, likeness, score`` of the best filing within ``NEAR`` of each name and day that reaches the score known for it.

    A name comes once with all its days, a company with all its filings, so that two names are compared once for all of them;
    days are those of one span that begins at ``first``.
    """
    theirs = Companies(companies)
    filed = [f - first for f in filed]
    level = levels(np.repeat(np.arange(len(filed)), [len(f) for f in filed]), np.concatenate(filed), len(companies), SPAN)
    most, every = _ADDS[level.max(0)], bounds(counted(names), counted(companies)) + form
    for name, mine, reach, score in zip(names, days, every, known, strict=True):
        near = most[mine - first] > -np.inf
        day = mine[near] - first
        out, cap = Found(day, score[near]), most[day]
        if not len(day):
            continue
        rest = np.flatnonzero(reach >= (out.best - cap).min() - _ROUNDING)
        rest = rest[np.argsort(-reach[rest], kind="stable")]
        k, step = 0, _STEP // 8
        while k < len(rest):
            some = rest[k : k + step]
            k, step = k + step, min(2 * step, _STEP)
            still = np.flatnonzero(out.best - cap <= reach[some[0]] + _ROUNDING)
            if not len(still):
                break
            _take_all(out, name, theirs, some, reach, level, still, filed, form, ids)
        yield out.rows(name, first)


def _take_all(out: Found, name: str, theirs: Companies, some: np.ndarray, reach: np.ndarray, level: np.ndarray, still: np.ndarray, filed: list[np.ndarray], form: np.ndarray, ids: list[np.ndarray]) -> None:
    """Holds a name against some companies for the days that are ``still`` open, in order of the most that they can reach on a day."""
    adds = _ADDS[level[some[:, None], out.days[still][None, :]]]
    can = (reach[some, None] + adds >= out.best[still] - _ROUNDING).any(1)
    some, adds = some[can], adds[can]
    if not len(some):
        return
    both = len(name) + theirs.sizes[some]
    likely = np.where(both > 0, 2 * theirs.in_order(name, some) / np.maximum(both, 1), 1.0) + form[some]
    reached = likely[:, None] + adds
    can = np.flatnonzero((reached >= out.best[still] - _ROUNDING).any(1))
    for j in can[np.argsort(-reached[can].max(1), kind="stable")].tolist():
        at = still[reached[j] >= out.best[still] - _ROUNDING]
        if len(at):
            k = some[j]
            out.take(likeness(name, theirs.names[k]), form[k], at, level[k, out.days[at]], filed[k], ids[k])


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column of lists of numbers."""
    if not len(column):
        return []
    ends = column.offsets.to_numpy()
    return np.split(column.values.to_numpy()[ends[0] : ends[-1]], ends[1:-1] - ends[0])


def _compared_near(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            of = {n: batch.column(n)[k].values for n in ("names", "days", "known", "companies", "filed", "form", "ids")}
            found = best_near(of["names"].to_pylist(), [d.astype(np.int64) for d in _lists(of["days"])], _lists(of["known"]), batch.column("span")[k].as_py() * SPAN, of["companies"].to_pylist(), [f.astype(np.int64) for f in _lists(of["filed"])], of["form"].to_numpy(), _lists(of["ids"]))
            yield _table([row for rows in found for row in rows])


def _compared_own(batches):
    """Names with filings of the very name, each in one row with its days and theirs."""
    for batch in batches:
        of = {n: _lists(batch.column(n)) for n in ("days", "known", "filed", "ids")}
        out: list[tuple] = []
        for k, (name, span, form) in enumerate(zip(batch.column("name").to_pylist(), batch.column("span").to_pylist(), batch.column("form").to_pylist(), strict=True)):
            days, filed = of["days"][k].astype(np.int64) - span * SPAN, of["filed"][k].astype(np.int64) - span * SPAN
            found = Found(days, of["known"][k])
            found.take(1.0, form, np.arange(len(days)), levels(np.zeros(len(filed), np.int64), filed, 1, SPAN)[0, days], filed, of["ids"][k])
            out += found.rows(name, span * SPAN)
        yield _table(out)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["name", "day", "filing_id", "likeness", "score"])


_FOUND = "name string, day int, filing_id bigint, likeness double, score double"


def _compared(batches):
    for batch in batches:
        out: list[tuple] = []
        for row in batch.to_pylist():
            days = np.array(row["days"], np.int64)
            for k, filing, likeness, score in best_of(row["names"], days, np.array(row["known"]), row["companies"], np.array(row["filed"], np.int64), np.array(row["form"]), np.array(row["ids"], np.int64)):
                out.append((row["names"][k], int(days[k]), filing, likeness, score))
        yield _table(out)


def _blocks(rows: DataFrame, key: str, block: str, most: Column | None = None, **lists: str) -> DataFrame:
    """Rows of one ``key`` in blocks, each column of ``lists`` as a list; ``key`` has few values, ``most`` is how many blocks a key needs."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK if most is None else most).alias("_parts"))
    spread = rows.join(F.broadcast(sizes), key).withColumn("_part", F.pmod(F.xxhash64(next(iter(lists.values()))), F.col("_parts")))
    held = F.collect_list(F.struct(*[F.col(c).alias(name) for name, c in lists.items()]))
    return spread.groupBy(key, "_part").agg(held.alias("_rows")).select(key, F.xxhash64(F.lit(block), key, "_part").alias(block), *[F.col(f"_rows.{name}").alias(name) for name in lists])


def _met(a: DataFrame, b: DataFrame, pairs: DataFrame, compared=_compared, *more: str) -> DataFrame:
    """The best of each name in pairs of blocks; pairs are spread whole, as there are few blocks of either side and much work in a pair."""
    parts = 4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = pairs.join(a, "a_block").join(b, "b_block").repartition(parts, "a_block", "b_block")
    return met.select("names", "days", "known", "companies", "filed", "form", "ids", *more).mapInArrow(compared, _FOUND)


def _band(length: Column) -> Column:
    return F.floor(F.log(length + 1) / F.log(F.lit(BAND))).cast("int")


def best_filing(deals: DataFrame, filings: DataFrame) -> DataFrame:
    """``deal_id, filing_id, score, confident``: the filing with the best score of each deal, the least id of several.

    ``deals``: deal_id, name, date; ``filings``: filing_id, company, filed, form.  Names that differ in case alone are one;
    deals and filings without a name take no part; without filings there are no rows.
    """
    day = lambda c: F.coalesce(F.datediff(c, F.lit("1970-01-01").cast("date")), F.lit(_NO_DAY))
    asked = deals.where("name IS NOT NULL").select("deal_id", F.lower("name").alias("name"), day(F.col("date")).alias("day"))
    form = F.when(F.col("form") == "D", FORM_D).otherwise(0.0)
    b = filings.where("company IS NOT NULL").groupBy(F.lower("company").alias("company"), day(F.col("filed")).alias("filed"), form.alias("form")).agg(F.min("filing_id").alias("id"))
    same = b.groupBy("company").agg(F.max(F.struct("form", -F.col("id"))).alias("s")).select(F.col("company").alias("name"), F.col("s.form").alias("same"), (-F.col("s.col2")).alias("id"))
    a = asked.select("name", "day").distinct().join(same, "name", "left").withColumn("known", F.coalesce(F.lit(1.0) + F.col("same"), F.lit(0.0)))
    equal = a.where("same IS NOT NULL").select("name", "day", F.col("id").alias("filing_id"), F.lit(1.0).alias("likeness"), F.col("known").alias("score"))

    # filings of one name, and deals of one name, are one row with all their days of a span and of those around it
    reached = F.explode(F.sequence(F.floor((F.col("filed") - REACH) / SPAN).cast("int"), F.floor((F.col("filed") + REACH) / SPAN).cast("int"))).alias("span")
    b_days = b.where(F.col("filed") != _NO_DAY).select("company", "form", "filed", "id", reached)
    held = b_days.groupBy("company", "form", "span").agg(F.collect_list(F.struct("filed", "id")).alias("f")).select("company", "form", "span", F.col("f.filed").alias("filed"), F.col("f.id").alias("ids"))
    a_days = a.where(F.col("day") != _NO_DAY).withColumn("span", F.floor(F.col("day") / SPAN).cast("int"))
    spans = lambda rows: rows.groupBy("name", "span").agg(F.collect_list(F.struct("day", "known")).alias("d")).select("name", "span", F.col("d.day").alias("days"), F.col("d.known").alias("known"))
    own = spans(a_days.where("same IS NOT NULL")).join(held.withColumnRenamed("company", "name"), ["name", "span"]).select("name", "span", "days", "known", "form", "filed", "ids").mapInArrow(_compared_own, _FOUND)
    own = written(own.groupBy("name", "day").agg(F.max_by(F.struct("filing_id", "likeness", "score"), F.struct("score", -F.col("filing_id"))).alias("b")).select("name", "day", "b.*"), "likeness-own")
    a_days = a_days.join(own.select("name", "day", F.col("score").alias("_own")), ["name", "day"], "left").withColumn("known", F.greatest("known", F.coalesce("_own", F.lit(0.0))))
    near_a = _blocks(spans(a_days.where(F.col("known") < _MOST - _ROUNDING)), "span", "a_block", names="name", days="days", known="known")
    near_b = _blocks(held, "span", "b_block", F.greatest(F.count("*") / (BLOCK * WIDE), F.sum(F.size("filed")) / _FILED), companies="company", filed="filed", form="form", ids="ids")
    pairs = near_a.select("a_block", "span").join(near_b.select("b_block", "span"), "span")
    other = _met(near_a.drop("span"), near_b.drop("span"), pairs, _compared_near, "span")
    near = written(own.unionByName(other), "likeness-near")  # read several times below

    known = a.select("name", "day", "known").unionByName(near.select("name", "day", F.col("score").alias("known"))).groupBy("name", "day").agg(F.max("known").alias("known"))
    far = known.where(F.col("known") < 1.0 + FORM_D - _ROUNDING).groupBy("name").agg(F.min("known").alias("known"))
    least = F.greatest(F.lit(0.0), F.col("known") - FORM_D - _ROUNDING)  # of the likeness
    low, high = F.floor(F.length("name") * least / (2 - least)), F.when(least > 0.01, F.ceil(F.length("name") * (2 - least) / least))
    far = far.withColumns({"low": _band(low), "high": F.coalesce(_band(high), F.lit(1 << 20)), "day": F.lit(_NO_DAY)}).withColumn("bands", F.struct("low", "high"))
    far_a = _blocks(far, "bands", "a_block", names="name", days="day", known="known")
    names = b.groupBy("company", "form").agg(F.min("id").alias("id")).withColumns({"band": _band(F.length("company")), "filed": F.lit(_NO_DAY)})
    far_b = _blocks(names, "band", "b_block", companies="company", filed="filed", form="form", ids="id")
    wide = far_b.agg(F.min("band").alias("least"), F.max("band").alias("most"))  # one row
    bands = far_a.select("a_block", "bands").join(F.broadcast(wide), (F.col("bands.low") <= F.col("most")) & (F.col("bands.high") >= F.col("least")))
    bands = bands.select("a_block", F.explode(F.sequence(F.greatest("bands.low", "least"), F.least("bands.high", "most"))).alias("band"))
    pairs = bands.join(far_b.select("b_block", "band"), "band").drop("band")
    beyond = _met(far_a.drop("bands"), far_b.drop("band"), pairs).drop("day")
    # by name: a deal takes it if it has none as good, and then it is beyond what days add to
    beyond = a.select("name", "day").join(beyond, "name")

    best = equal.unionByName(near).unionByName(beyond.select("name", "day", "filing_id", "likeness", "score"))
    best = best.groupBy("name", "day").agg(F.max_by(F.struct("filing_id", "likeness", "score"), F.struct("score", -F.col("filing_id"))).alias("b"))
    dated = filings.select("filing_id", day(F.col("filed")).alias("filed"))
    out = asked.join(best.select("name", "day", "b.*"), ["name", "day"]).join(dated, "filing_id")
    gap = F.when((F.col("day") != _NO_DAY) & (F.col("filed") != _NO_DAY), F.abs(F.col("day") - F.col("filed")))
    return out.select("deal_id", "filing_id", F.round("score", 6).alias("score"), ((F.col("likeness") > 0.8) & F.coalesce(gap <= 30, F.lit(False))).alias("confident"))
