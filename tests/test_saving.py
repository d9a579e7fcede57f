"""The one-pass save against a plain loop over all deals, and its tiers against the joins that look for duplicates."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import fixed, names
from ledgerloom.operators import fold
from ledgerloom.operators.linked import linked_groups
from ledgerloom.operators.resolve import match_tiers
from ledgerloom.operators.save import STORED, _rows, company_key, company_links, prepared, save

TODAY = datetime.date(2026, 1, 31)
NEW = "new_id long, seq long, name string, round_type string, amount string, amount_source string, sec_amount_usd long, round_date date, published_date date"
NAMES = ["Nova", "Nova Labs", "NOVA", "Novabridge", "Novabridges One", "Novabrick", "Orbit", "Orbit AI", "Orb", "Abc Tech", "Abd", "小米", "华为", "Zenith Health Inc.", "Zenithal", None, ""]
AMOUNTS = [None, "$4M", "$4.1M", "$4.3M", "$5M", "$40M", "$45M", "$500M", "undisclosed", "$100K", "$900"]


def day(rng: random.Random) -> datetime.date | None:
    return None if rng.random() < 0.2 else rng.choice([TODAY - datetime.timedelta(days=rng.randrange(12)), TODAY - datetime.timedelta(days=rng.randrange(500)), datetime.date(2026, 1, 1)])


def incoming(spark, n: int, seed: int, chosen=NAMES, first: int = 0):
    rng = random.Random(seed)
    rows = []
    for k in range(first, first + n):
        source = rng.choice([None, "article", "sec_form_d"])
        rows.append((1000 + k, k, rng.choice(chosen), rng.choice(["seed", "series_a", "series_b", None]), rng.choice(AMOUNTS), source, 4_050_000 if source == "sec_form_d" and rng.random() < 0.7 else None, day(rng), day(rng)))
    return spark.createDataFrame(rows, NEW)


def stored_deals(spark, n: int, seed: int):
    rng = random.Random(seed)
    made = prepared(incoming(spark, n, seed), TODAY).select(*STORED)
    ages = spark.createDataFrame([(1000 + k, rng.randrange(1, 90)) for k in range(n)], "deal_id long, age int")
    old = made.join(ages, "deal_id").withColumn("created_date", F.date_sub(F.lit(TODAY), F.col("age"))).withColumn("deal_id", F.col("deal_id") - 1000)
    return spark.createDataFrame(old.select(*STORED).collect(), old.select(*STORED).schema)


def names_match(a: dict, b: dict) -> bool:
    if not a["norm"] and not b["norm"]:
        return a["low"] is not None and a["low"] == b["low"] and a["norm"] == b["norm"]
    if not a["norm"] or not b["norm"]:
        return False
    short, long = sorted((a["norm"], b["norm"]), key=len)
    return short == long or len(short) >= 3 and long.startswith(short) and long[len(short) :] in fixed.MATCH_SUFFIXES


def plain_save(old: list[dict], new: list[dict], today: int) -> tuple[list[dict], list[tuple]]:
    """Every new deal against all deals there are, with no index and no block."""
    deals, told, merger = {d["deal_id"]: dict(d) for d in old}, [], fold.Block(today)
    for n in sorted((dict(d) for d in new), key=lambda d: d["seq"]):
        hits = [(t, i) for i, d in deals.items() if names_match(n, d) and (t := fold.name_tier(n, d, today))]
        for i, d in deals.items():
            near = n["amount_usd"] and d["amount_usd"] is not None and int(n["amount_usd"] * 0.95) <= d["amount_usd"] <= int(n["amount_usd"] * 1.05)
            if near and n["day"] is not None and n["day"] == d["day"] and n["round_type"] is not None and n["round_type"] == d["round_type"] and fold.starts_alike(n["norm"], d["norm"]):
                hits.append((2, i))
        by = lambda keys, column: min((i for i, d in deals.items() if d[column] is not None and d[column] in keys), default=None)
        if hits:
            tier, i = min(hits)
            before = deals[i]
            merger.add(before)
            merger.merge(before, n)
            told.append((n["seq"], "merged", tier, i))
        elif (i := by([n["amount_key"]], "amount_key")) is not None:
            told.append((n["seq"], "amount key", None, i))
        elif (i := by(n["adjacent"], "dedup_key")) is not None:
            told.append((n["seq"], "adjacent key", None, i))
        elif (i := by([n["dedup_key"]], "dedup_key")) is not None:
            told.append((n["seq"], "key", None, i))
        else:
            deals[n["deal_id"]] = n
            told.append((n["seq"], "inserted", None, n["deal_id"]))
    return list(deals.values()), told


def of_rows(df, is_new):
    return [r.asDict() for r in _rows(df.withColumn("block", F.lit("")), is_new).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_hits_of_the_fold_are_those_of_the_joins(spark, seed):
    old, new = stored_deals(spark, 250, seed), prepared(incoming(spark, 400, seed + 100), TODAY)
    joined = {r["in_id"]: (r["tier"], r["deal_id"]) for r in match_tiers(new, old, TODAY).collect()}
    block = fold.Block((TODAY - datetime.date(1970, 1, 1)).days)
    for d in of_rows(old, False):
        block.add(d)
    assert {n["deal_id"]: h for n in of_rows(new, True) if (h := block.hit(n))} == joined
    assert {t for t, _ in joined.values()} >= {1, 2, 3, 6, 8}


@pytest.mark.parametrize("seed, n_old, n_new", [(3, 120, 300), (4, 0, 400), (5, 200, 0), (6, 30, 500)])
def test_save_is_the_plain_loop(spark, seed, n_old, n_new):
    old, more = stored_deals(spark, n_old, seed), incoming(spark, n_new, seed + 100)
    deals, told = save(old, more, TODAY)
    after, expected = plain_save(of_rows(old, False), of_rows(prepared(more, TODAY), True), (TODAY - datetime.date(1970, 1, 1)).days)
    assert sorted(map(tuple, told.select("seq", "outcome", "tier", "deal_id").collect())) == sorted(expected)
    pick = lambda d: (d["deal_id"], d["name"], d["amount"], d["amount_usd"], d["amount_source"], d["day"], None if d["date_confidence"] is None else round(d["date_confidence"], 9), d["date_source_count"])
    got = [r.asDict() for r in deals.withColumn("day", F.unix_date("announced_date")).collect()]
    assert sorted(map(pick, got)) == sorted(map(pick, after))


def test_a_thousand_deals_of_one_company(spark):
    more = incoming(spark, 1000, 9, ["Nova", "Nova Labs"])
    deals, told = save(stored_deals(spark, 0, 1), more, TODAY)
    outcomes = {r["outcome"]: r["count"] for r in told.groupBy("outcome").count().collect()}
    assert sum(outcomes.values()) == 1000
    assert deals.count() == outcomes["inserted"] < 100  # few enough to hold


def test_deals_without_new_ones_of_their_block_are_not_read_again(spark):
    old = stored_deals(spark, 150, 7)
    deals, _ = save(old, incoming(spark, 20, 8, ["Zenithal"]), TODAY)
    rows = lambda df: {r["deal_id"]: r for r in df.select(*STORED).collect()}
    before, after = rows(old), rows(deals)
    assert all(after[k] == r for k, r in before.items() if r["name"] and not r["name"].startswith("Zenith"))


def test_links_between_companies_hold_all_that_tier_2_may_meet(spark):
    rng = random.Random(5)
    made = prepared(incoming(spark, 300, 55, ["".join(rng.choice("ab") for _ in range(rng.randrange(3, 9))) for _ in range(60)]), TODAY).withColumn("company", company_key(F.col("norm"))).cache()
    links = {(r["a"], r["b"]) for r in company_links(made.limit(0).select(*STORED, "company"), made).collect()}
    rows = made.collect()
    for n in rows:
        for d in rows:
            if n["company"] != d["company"] and n["announced_date"] and n["announced_date"] == d["announced_date"] and n["amount_usd"] and d["amount_usd"] is not None:
                if int(n["amount_usd"] * 0.95) <= d["amount_usd"] <= int(n["amount_usd"] * 1.05) and fold.starts_alike(n["norm"], d["norm"]):
                    assert (n["company"], d["company"]) in links


def test_linked_groups(spark):
    pairs = [(f"c{k:03}", f"c{k + 1:03}") for k in range(60)] + [("x", "y"), ("y", "z"), ("z", "x"), ("q", "q"), ("s", "r")]
    got = {r["key"]: r["least"] for r in linked_groups(spark.createDataFrame(pairs, "a string, b string")).collect()}
    least = lambda k: got.get(k, k)
    assert {least(f"c{k:03}") for k in range(61)} == {"c000"}
    assert [least(k) for k in "xyzqrs"] == ["x", "x", "x", "q", "r", "r"]
    assert linked_groups(spark.createDataFrame([], "a string, b string")).count() == 0


def test_matching_keys_are_those_of_names_match(spark):
    norms = ["nova", "novalabs", "novaai", "no", "nox", "novax", "novalabsai", "abcify", "abc", "abcif", "=x"]
    pairs = [(a, b) for a in norms[:-1] for b in norms[:-1]]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("m", names.names_match(F.col("a"), F.col("b"), F.col("a"), F.col("b")))
    assert all((r["b"] in fold.matching_keys(r["a"])) == r["m"] for r in df.collect())


def test_rows_for_clients(spark):
    from ledgerloom.operators.rows import deal_rows

    d = "deal_id long, company_id long, round_type string, amount string, announced_date date, enterprise_category string, is_enterprise_ai boolean, is_ai_deal boolean, founders_json string"
    deals = spark.createDataFrame([
        (1, 1, "seed", "", None, None, True, None, '[{"title":"CEO","linkedin_url":"https://www.linkedin.com/in/bob"},{"name":"C","linkedin_url":"unknown"}]'), (2, 9, "seed", "$4M", TODAY, None, False, True, "broken"), (3, 1, None, None, None, None, None, None, None),
    ], d)
    investors = spark.createDataFrame([(1, 2, "B", True, True), (1, 1, "A", True, True), (1, 0, "Z", False, False), (2, 0, "Y", True, False)], "deal_id long, position long, investor_name string, is_lead boolean, is_tracked_fund boolean")
    companies = spark.createDataFrame([(1, "Nova", "www.nova.ai", "none")], "company_id long, name string, website string, linkedin_url string")
    articles = spark.createDataFrame([(7, 1, "late", "x", "l"), (5, 1, "first", None, "The title")], "article_id long, deal_id long, url string, source string, title string")
    got = {r["deal_id"]: r["row"] for r in deal_rows(deals, investors, companies, articles).collect()}
    one = got[1]
    assert (one["id"], one["startup_name"], one["investor_roles"], one["lead_investor"], one["amount_invested"], one["date"], one["is_ai_deal"]) == ("1", "Nova", ["non_lead", "lead", "lead"], "B", "Undisclosed", "", True)
    assert (one["company_website"], one["company_linkedin"], one["source_url"], one["source_name"]) == ("www.nova.ai", None, "first", "The title")
    assert [tuple(f) for f in one["founders"]] == [("Unknown", "CEO", "https://www.linkedin.com/in/bob"), ("C", None, None)]
    assert (got[2]["startup_name"], got[2]["founders"], got[2]["lead_investor"], got[2]["date"]) == ("Unknown", None, None, "2026-01-31")
    assert got[3]["investor_roles"] == ["stealth"]


def test_merges_of_the_fold_are_those_of_the_columns(spark):
    from ledgerloom.operators import merge

    days = [None, datetime.date(2026, 1, 1), datetime.date(2026, 1, 2), datetime.date(2026, 1, 10), datetime.date(2025, 12, 20)]
    pairs = [(k, a, x, b, y) for k, (a, x, b, y) in enumerate((a, x, b, y) for a in days for x in (None, 0.4, 0.6, 0.95) for b in days for y in (0.4, 0.5, 0.7))]
    df = spark.createDataFrame(pairs, "k int, old date, old_sure double, new date, new_sure double")
    want = {r["k"]: r["m"] for r in df.select("k", merge.merged_date(F.col("old"), F.coalesce("old_sure", F.lit(0.5)), F.col("new"), F.col("new_sure")).alias("m")).collect()}
    epoch = datetime.date(1970, 1, 1)
    number = lambda d: None if d is None else (d - epoch).days
    first = lambda d: d is not None and d.day == 1 and d.month in (1, 4, 7, 10)
    plain = {"norm": "nova", "low": "nova", "round_type": "seed", "created": 0, "amount": None, "amount_usd": None, "amount_source": "article", "real": False, "filed": False, "dedup_key": None, "amount_key": None, "date_source_count": 1}
    for k, a, x, b, y in pairs:
        block, old = fold.Block(number(TODAY)), plain | {"deal_id": k, "day": number(a), "placeholder": first(a), "date_confidence": x}
        block.add(old)
        block.merge(old, plain | {"deal_id": -1, "day": number(b), "placeholder": first(b), "date_confidence": y})
        sure = 0.5 if old["date_confidence"] is None else old["date_confidence"]
        assert (old["day"], round(sure, 9)) == (number(want[k]["date"]), round(want[k]["sure"], 9)), (a, x, b, y)
        assert [d["day"] for place in block._places(old) for d in place.values()] == [old["day"]] * len(block._places(old))


def rows_of(spark, since: int, kind: str = "Join") -> int:
    """Rows that nodes of a kind gave in the queries that ran after the first so many."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = store.executionsList()
    for k in range(since, ran.size()):
        at = ran.apply(k).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if kind in node.name():
                metrics = node.metrics()
                for m in (metrics.apply(j) for j in range(metrics.size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        total += int(values.apply(m.accumulatorId()).replace(",", ""))
    return total


def test_tiers_of_one_name_do_not_meet_all_its_deals(spark):
    """Deals over many years of one company: each meets those near it, not all."""
    n = 3000
    k = F.col("id")
    deals = spark.range(n).select(k.alias("deal_id"), F.lit("Nova").alias("name"), F.lit("nova").alias("norm"), F.lit("seed").alias("round_type"), (k * 7919 % n * 100_000 + 1_000_000).alias("amount_usd"), F.date_sub(F.lit(TODAY), (k * 3).cast("int")).alias("announced_date"))
    deals = deals.withColumn("created_date", F.col("announced_date"))
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = {r["in_id"]: (r["tier"], r["deal_id"]) for r in match_tiers(deals.where("deal_id % 2 = 0"), deals.where("deal_id % 2 = 1"), TODAY).collect()}
    assert got == {i: (1, i - 1 if i else 1) for i in range(0, n, 2)}
    assert 0 < rows_of(spark, before) < 20 * n


def test_companies_with_beginnings_of_their_own_bring_no_deals_to_the_links(spark):
    """Long names that share nothing: only their names are cut into beginnings, once, at lengths that names have."""
    n = 2000
    k = F.col("id")
    rows = spark.range(n).select((k + 1).alias("deal_id"), F.md5((k % 200).cast("string")).alias("company"), F.date_sub(F.lit(TODAY), (k % 300).cast("int")).alias("announced_date"), (k * 1000 + 5_000_000).alias("amount_usd"))
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    assert company_links(rows, rows).count() == 0
    assert 0 < rows_of(spark, before, "Generate") <= 200 * 30


def test_keys_of_new_deals_are_made_after_the_shuffle(spark, monkeypatch):
    from ledgerloom.operators import save as module

    tables = {}
    monkeypatch.setattr(module, "written", lambda df, name, to=module.written: tables.setdefault(name, df.columns) and to(df, name))
    assert save(stored_deals(spark, 20, 3), incoming(spark, 20, 4), TODAY)[1].count() == 20
    assert "save-new" in tables and not {"dedup_key", "amount_key", "adjacent"} & set(tables["save-new"])


def test_deals_beyond_all_tiers_are_not_looked_at(monkeypatch):
    """One company with deals of all rounds over many years: a report is held against the few that a tier may take."""
    looked = []
    monkeypatch.setattr(fold, "name_tier", lambda new, old, today, to=fold.name_tier: looked.append(old) or to(new, old, today))
    plain = {"name": "Nova", "norm": "nova", "low": "nova", "created": 0, "amount": None, "amount_usd": None, "amount_source": "article", "real": False, "filed": False, "dedup_key": None, "amount_key": None, "adjacent": [], "placeholder": False, "date_confidence": 0.5, "date_source_count": 1}
    block = fold.Block(20_000)
    for k in range(2000):
        block.add(plain | {"deal_id": k, "day": 10_000 + k * 2, "round_type": f"r{k % 20}"})
    for day in range(10_100, 13_900, 38):
        best = min((t, d["deal_id"]) for d in block.deals.values() if (t := fold.name_tier(plain | {"day": day, "round_type": "r3"}, d, 20_000)))
        looked.clear()
        assert block.hit(plain | {"day": day, "round_type": "r3"}) == best
        assert 0 < len(looked) < 60  # of some 550 in the slots around


def test_folded_rows_keep_nulls_and_kinds():
    """Rows of one batch come out as outcomes and deals, whole numbers as such beside nulls."""
    import pyarrow as pa

    row = {"block": "b", "is_new": True, "seq": 1, "deal_id": 7, "name": "Nova", "low": "nova", "norm": "nova", "round_type": None, "amount": None, "amount_usd": None, "amount_source": "article", "day": None, "placeholder": False, "date_confidence": None, "date_source_count": 1, "created": 5, "real": False, "filed": False, "dedup_key": "k", "amount_key": None, "adjacent": ["x", "y"]}
    old = row | {"is_new": False, "seq": None, "deal_id": 2**53 + 1, "name": "Other", "low": "other", "norm": "other", "amount_usd": 2**53 + 3, "day": 9, "date_confidence": 0.5, "dedup_key": "x", "adjacent": None}
    kinds = pa.schema([(n, pa.list_(pa.string()) if n == "adjacent" else pa.bool_() if n in ("is_new", "placeholder", "real", "filed") else pa.float64() if n == "date_confidence" else pa.int32() if n in ("day", "created") else pa.int64() if n in ("seq", "deal_id", "amount_usd", "date_source_count") else pa.string()) for n in row])
    got = [r for b in fold.folded(iter([pa.RecordBatch.from_pylist([old, row, row | {"seq": 2, "deal_id": 8, "norm": "z", "low": "z", "dedup_key": "q", "adjacent": ["p"]}], kinds)]), 10) for r in b.to_pylist()]
    assert [(r["kind"], r["seq"], r["outcome"], r["tier"], r["deal_id"]) for r in got] == [("outcome", 1, "adjacent key", None, 2**53 + 1), ("outcome", 2, "inserted", None, 8), ("deal", None, None, None, 8)]
    assert (got[2]["amount_usd"], got[2]["day"], got[2]["date_confidence"], got[2]["created"]) == (None, None, None, 5)


def test_plain_amounts_are_read_as_parsed(spark):
    from ledgerloom.functions import amounts

    texts = [None, "", "$4M", "$4.25M", "$1,500,000", "$900", "$999.5", "$1000", "$47.5B", "$3K", "$12,3M", "4M", "$4m", "$.5M", "$5.", "$1.2.3M", "undisclosed", "up to $5 million", "$5-10M", "$4M ", "US$7M", "$٤M", "€3M", "$4MM"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", amounts.parsed(F.col("t")).alias("a"), amounts.parsed_or_plain(F.col("t")).alias("b"))
    assert [r["b"] for r in df.collect()] == [r["a"] for r in df.collect()]
