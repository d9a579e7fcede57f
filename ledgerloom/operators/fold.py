"""The fold of one block of deals: every new deal meets what the earlier ones of its block left, in order of arrival.

A block's stored deals come first, then its new ones, as sorted rows of a stream; only its deals are held, never its new
ones.  What a block holds stays small however many new deals come: a new deal that isn't near to a held one in name, round,
year and amount becomes a deal, any other one doesn't, so that a company's name holds about as many deals as there are
rounds, years and steps of 15 % in amount.
"""

from __future__ import annotations

import functools
import math
import operator
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa

from ledgerloom.functions import fixed

#: Days in a slot of dates; tiers look at most 365 days around.
SLOT = 366

OUT = pa.schema([
    ("kind", pa.string()), ("seq", pa.int64()), ("outcome", pa.string()), ("tier", pa.int32()), ("deal_id", pa.int64()), ("name", pa.string()), ("norm", pa.string()), ("round_type", pa.string()), ("amount", pa.string()),
    ("amount_usd", pa.int64()), ("amount_source", pa.string()), ("day", pa.int32()), ("date_confidence", pa.float64()), ("date_source_count", pa.int64()), ("created", pa.int32()), ("dedup_key", pa.string()), ("amount_key", pa.string()),
])
OUT_DDL = "kind string, seq long, outcome string, tier int, deal_id long, name string, norm string, round_type string, amount string, amount_usd long, amount_source string, day int, date_confidence double, date_source_count long, created int, dedup_key string, amount_key string"
_TOLD = ["seq", "outcome", "tier", "deal_id"]
_DEAL = [f.name for f in OUT if f.name not in ("kind", "seq", "outcome", "tier")]
_deal = operator.itemgetter(*_DEAL)


def amounts_agree(n: int | None, other: int | None) -> bool:
    """Not too far apart, unless one looks like the valuation of the other; unknown amounts never are."""
    if not n or not other:
        return True
    small, large = sorted((n, other))
    ratio = large / max(1, small)
    return ratio <= 5 or (8 <= ratio <= 12 and small >= 50_000_000 and large >= 400_000_000)


def name_tier(new: dict, old: dict, today: int) -> int | None:
    """The first tier under which a new deal repeats a deal whose name matches, tier 2 apart."""
    d, sd, n, sn = new["day"], old["day"], new["amount_usd"], old["amount_usd"]
    age = math.inf if old["created"] is None else today - old["created"]
    gap = None if d is None or sd is None else abs(d - sd)
    away = gap if gap is not None else age if d is not None or sd is None else today - sd
    round_too = new["round_type"] is not None and new["round_type"] == old["round_type"]
    if away > (365 if round_too else 60) and not (round_too and age <= 30):
        return None  # beyond all tiers
    same = new["low"] == old["low"]
    if same and round_too and (away <= (10 if gap is None else 5) if d is not None else away <= 21 and age <= 21):
        return 1
    if n and sn is not None and math.floor(n * 0.9) <= sn <= math.floor(n * 1.1) and away <= (60 if gap is None else 30):
        return 3
    if gap == 0:
        return 4 if same else 5
    if round_too and amounts_agree(n, sn):
        if (gap is not None and gap <= 30) if d is not None else age <= 30:
            return 6
        if d is not None and sd is None and age <= 30:
            return 7
    if round_too and away <= 365 and (abs(n - sn) <= 0.15 * max(n, sn) if n and sn else gap is None or gap <= 60):
        return 8
    return None


def starts_alike(a: str, b: str) -> bool:
    if a is None or b is None or min(len(a), len(b)) < 3:
        return False
    start = max(4, math.floor(0.6 * min(len(a), len(b))))
    return a[:start] == b[:start]


@functools.lru_cache(1 << 12)
def matching_keys(key: str) -> list[str]:
    """Names that match one: itself, and it with or without one suffix; a name without a normal form ("=...") matches itself alone."""
    if key.startswith("="):
        return [key]
    longer = [key + s for s in fixed.MATCH_SUFFIXES] if len(key) >= 3 else []
    return [key, *longer, *[key[: -len(s)] for s in fixed.MATCH_SUFFIXES if key.endswith(s) and len(key) >= len(s) + 3]]


class Block:
    """The deals of one block, by name and slot of dates, by day and round, and by key."""

    def __init__(self, today: int):
        self.today = today
        self.deals: dict[int, dict] = {}
        self.named: dict[str, dict[int | None, dict[int, dict]]] = defaultdict(lambda: defaultdict(dict))
        self.meeting: dict[str, list[dict[int | None, dict[int, dict]]]] = {}
        self.dated: dict[tuple, dict[int, dict]] = defaultdict(dict)
        self.keyed: dict[str, int] = {}
        self.changed: set[int] = set()

    @staticmethod
    def _key(deal: dict) -> str | None:
        return deal["norm"] or (None if deal["low"] is None else "=" + deal["low"])

    def _places(self, deal: dict) -> list[dict]:
        key, day = self._key(deal), deal["day"]
        if key is not None and key not in self.named:
            self.meeting.clear()
        slots = [] if key is None else [self.named[key][None if day is None else day // SLOT]]
        return slots + ([] if day is None else [self.dated[day, deal["round_type"]]])

    def add(self, deal: dict) -> None:
        self.deals[deal["deal_id"]] = deal
        for place in self._places(deal):
            place[deal["deal_id"]] = deal
        for key in (deal["dedup_key"], deal["amount_key"]):
            if key is not None:
                self.keyed[key] = min(self.keyed.get(key, deal["deal_id"]), deal["deal_id"])

    def _met(self, key: str) -> list[dict[int | None, dict[int, dict]]]:
        """The slots of each name that matches one."""
        found = self.meeting.get(key)
        if found is None:
            found = self.meeting[key] = [self.named[k] for k in matching_keys(key) if k in self.named]
        return found

    def hit(self, new: dict) -> tuple[int, int] | None:
        """The least tier and deal that a new deal repeats.

        Where both days are known, no tier takes deals of another round over 30 days away or any over 365, which are most.
        """
        best, key, day, round_type = None, self._key(new), new["day"], new["round_type"]
        around = () if day is None else (None, day // SLOT - 1, day // SLOT, day // SLOT + 1)
        for slots in self._met(key) if key is not None else ():
            for slot in around or list(slots):
                for deal in slots[slot].values() if slot in slots else ():
                    if around and slot is not None:
                        gap = abs(day - deal["day"])
                        if gap > 30 and (gap > 365 or deal["round_type"] != round_type):
                            continue
                    tier = name_tier(new, deal, self.today)
                    if tier and (best is None or (tier, deal["deal_id"]) < best):
                        best = tier, deal["deal_id"]
        n = new["amount_usd"]
        if n and day is not None and new["round_type"] is not None and (best is None or best[0] > 1):
            for deal in self.dated.get((day, new["round_type"]), {}).values():
                if deal["amount_usd"] is not None and math.floor(n * 0.95) <= deal["amount_usd"] <= math.floor(n * 1.05) and starts_alike(new["norm"], deal["norm"]):
                    best = min(best or (9, 0), (2, deal["deal_id"]))
        return best

    def save(self, new: dict) -> tuple[int, str, int | None, int]:
        """The outcome of a new deal: ``seq, outcome, tier, deal_id``."""
        tell = lambda outcome, deal_id, tier=None: (new["seq"], outcome, tier, deal_id)
        if hit := self.hit(new):
            self.merge(self.deals[hit[1]], new)
            return tell("merged", hit[1], hit[0])
        if new["amount_key"] in self.keyed:
            return tell("amount key", self.keyed[new["amount_key"]])
        if near := [self.keyed[k] for k in new["adjacent"] if k in self.keyed]:
            return tell("adjacent key", min(near))
        if new["dedup_key"] in self.keyed:
            return tell("key", self.keyed[new["dedup_key"]])
        self.add(new)
        self.changed.add(new["deal_id"])
        return tell("inserted", new["deal_id"])

    def merge(self, old: dict, new: dict) -> None:
        """Dates by their sureness, amounts by their source; the rules of ``merge.merged_date`` and ``merge.merged_amount``."""
        self.changed.add(old["deal_id"])
        if new["day"] is not None:
            sure, new_sure = 0.5 if old["date_confidence"] is None else old["date_confidence"], new["date_confidence"]
            day, count = None, (1 if old["date_source_count"] is None else old["date_source_count"]) + 1
            if old["day"] is None:
                day, sure, count = new["day"], new_sure, 1
            elif abs(new["day"] - old["day"]) <= 1:
                sure = min(0.95, sure + 0.1)
            elif new_sure > sure:
                day, sure = new["day"], new_sure
            elif (old["placeholder"] and not new["placeholder"]) or (new["day"] < old["day"] and new_sure >= sure - 0.1):
                day, sure = new["day"], max(sure, new_sure)
            else:
                count = old["date_source_count"]
            old["date_confidence"], old["date_source_count"] = sure, count
            if day is not None and day != old["day"]:
                for place in self._places(old):
                    del place[old["deal_id"]]
                old["day"], old["placeholder"] = day, new["placeholder"]
                for place in self._places(old):
                    place[old["deal_id"]] = old
        if old["amount_source"] != "sec_form_d" if new["filed"] else new["real"] and not old["real"]:
            old.update({c: new[c] for c in ("amount", "amount_usd", "amount_source", "real")})

    def after(self) -> list[tuple]:
        """The deals that are new or changed."""
        return [_deal(self.deals[k]) for k in sorted(self.changed)]


def _values(column: pa.Array) -> list:
    """The values of a column; Arrow makes those of strings and whole numbers faster all at once than one by one."""
    if pa.types.is_list(column.type):
        ends, flat = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False)
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    if pa.types.is_floating(column.type):
        return column.to_pylist()
    return column.to_pandas(integer_object_nulls=True).tolist()


def _batch(kind: str, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    columns = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {}
    arrays = [pa.array([kind] * len(rows) if f.name == "kind" else columns[f.name], f.type) if f.name == "kind" or f.name in columns else pa.nulls(len(rows), f.type) for f in OUT]
    return pa.RecordBatch.from_arrays(arrays, schema=OUT)


def folded(batches: Iterator[pa.RecordBatch], today: int, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Outcomes and changed deals of blocks, from rows in order of block, stored before new, and arrival."""
    block, name, told, deals = Block(today), None, [], []
    for batch in batches:
        names = batch.schema.names
        for values in zip(*map(_values, batch.columns), strict=True):
            row = dict(zip(names, values, strict=True))
            if row["block"] != name:
                deals += block.after()
                block, name = Block(today), row["block"]
            if row["is_new"]:
                told.append(block.save(row))
            else:
                block.add(row)
            if len(told) + len(deals) >= most:
                yield _batch("outcome", _TOLD, told)
                yield _batch("deal", _DEAL, deals)
                told, deals = [], []
    yield _batch("outcome", _TOLD, told)
    yield _batch("deal", _DEAL, deals + block.after())
