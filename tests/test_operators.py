"""Resolution, validation, merging, readers and streams on small tables."""

import datetime
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import names
from ledgerloom.operators import likeness, merge, prefilter, resolve, validate
from ledgerloom.sources import exports
from ledgerloom.streaming import flows

D = datetime.date
AS_OF = D(2026, 1, 31)
DEAL = "deal_id long, name string, round_type string, amount_usd long, announced_date date, created_date date"


def tier(spark, stored, incoming):
    frame = lambda k, row: spark.createDataFrame([(k, *row)], DEAL).withColumn("norm", names.normal_form(F.col("name")))
    got = resolve.match_tiers(frame(2, incoming), frame(1, stored), AS_OF).collect()
    return got[0]["tier"] if got else None


M = 1_000_000
TIERS = [
    (("Torq", "series_d", 140 * M, D(2026, 1, 11), D(2026, 1, 11)), ("TORQ", "series_d", 140 * M, D(2026, 1, 12), AS_OF), 1),
    (("Torq", "series_d", 140 * M, D(2026, 1, 11), D(2026, 1, 11)), ("Torq", "series_d", 140 * M, D(2026, 1, 15), AS_OF), 1),
    (("Torq", "series_d", 140 * M, D(2026, 1, 11), D(2026, 1, 11)), ("Torq", "series_d", 140 * M, D(2026, 1, 17), AS_OF), 3),
    (("Acme Robotics Corp", "series_a", 20 * M, D(2026, 1, 10), D(2026, 1, 10)), ("Acme Robotix", "series_a", 20_400_000, D(2026, 1, 10), AS_OF), 2),
    (("Parloa", "growth", 350 * M, D(2026, 1, 15), D(2026, 1, 15)), ("Parloa", "series_d", 350 * M, D(2026, 1, 16), AS_OF), 3),
    (("Leona", "seed", 5 * M, D(2026, 1, 10), D(2026, 1, 10)), ("Leona Health", "series_a", 40 * M, D(2026, 1, 10), AS_OF), 5),
    (("Emergent", "series_b", None, D(2026, 1, 1), D(2026, 1, 1)), ("Emergent", "series_b", 70 * M, D(2026, 1, 20), AS_OF), 6),
    (("Foo", "seed", 5 * M, D(2026, 1, 1), D(2026, 1, 1)), ("Foo", "seed", 40 * M, D(2026, 1, 20), AS_OF), None),
    (("Foo", "series_b", 60 * M, D(2026, 1, 1), D(2026, 1, 1)), ("Foo", "series_b", 600 * M, D(2026, 1, 20), AS_OF), 6),
    (("Foo Labs", "seed", 4 * M, None, D(2026, 1, 20)), ("Foo", "seed", None, D(2026, 1, 25), AS_OF), 7),
    (("Foo", "series_a", 20 * M, D(2025, 7, 1), D(2025, 7, 1)), ("Foo", "series_a", 22 * M, D(2026, 1, 17), AS_OF), 8),
    (("Foo", "series_a", None, D(2025, 10, 1), D(2025, 10, 1)), ("Foo", "series_a", None, D(2026, 1, 9), AS_OF), None),
    (("Bar", "series_a", 20 * M, D(2026, 1, 9), D(2026, 1, 9)), ("Foo", "series_a", 20 * M, D(2026, 1, 9), AS_OF), None),
]


@pytest.mark.parametrize(("stored", "incoming", "expected"), TIERS)
def test_tiers(spark, stored, incoming, expected):
    assert tier(spark, stored, incoming) == expected


def test_fresh_contents(spark):
    articles = spark.createDataFrame([(1, ""), (2, None), (3, "twin"), (4, "twin"), (5, "a" * 401), (6, "b" * 400), (7, "c" * 101), (8, "d" * 100), (9, "e")], "article_id long, text string")
    from ledgerloom.functions.text import content_fingerprint

    length = {5: 200, 6: 200, 7: 10, 8: 10, 9: 1}
    stored = articles.where("article_id >= 5").select(content_fingerprint(F.col("text")).alias("content_hash"), F.create_map(*[F.lit(x) for kv in length.items() for x in kv])[F.col("article_id").cast("int")].alias("content_length"), F.when(F.col("article_id") == 9, F.lit(AS_OF)).otherwise(F.lit(D(2026, 2, 9))).alias("expires_on"))
    ids = lambda df: sorted(r["article_id"] for r in df.collect())
    assert ids(prefilter.fresh_contents(articles, stored, AS_OF)) == [1, 2, 3, 5, 7, 9]
    assert ids(prefilter.fresh_contents(articles, stored, AS_OF, one_of_twins=False)) == [1, 2, 3, 4, 5, 7, 9]


EXTRACTION = (
    "text string, external boolean, startup_name string, startup_description string, round_label string, amount_usd long, category string, is_ai boolean, is_enterprise boolean, announcement boolean, "
    "confidence double, snippet string, lead_investors array<string>, participants array<string>, founders array<string>, tracked_fund string"
)


def judged(spark, **changes):
    row = {
        "text": "Acme raised $5 million led by Foo Capital. Jane Doe founded it.", "external": False, "startup_name": "Acme", "startup_description": "b2b software", "round_label": "seed", "amount_usd": 5 * M,
        "category": "vertical_saas", "is_ai": True, "is_enterprise": True, "announcement": True, "confidence": 0.9, "snippet": "led by Foo Capital", "lead_investors": ["Foo Capital"], "participants": ["Nobody Inc"],
        "founders": ["Jane Doe"], "tracked_fund": "accel",
    } | changes
    return validate.judge(spark.createDataFrame([tuple(row.values())], EXTRACTION)).collect()[0]


def test_validation_keeps_what_is_grounded(spark):
    x = judged(spark)
    assert (x["verdict"], round(x["confidence"], 6), x["lead_status"], x["participants"], x["band"]) == ("accepted", 0.9, "confirmed_lead", [], "0.65 and over")


@pytest.mark.parametrize(("changes", "confidence"), [
    ({"founders": ["A Bcd", "Efg Hij", "Klm Nop"]}, 0.81), ({"founders": ["Abc Def"] * 6}, 0.80), ({"lead_investors": ["Zzzz One"]}, 0.85), ({"lead_investors": [f"Zzz{k} One" for k in range(5)]}, 0.75),
    ({"snippet": None, "text": "Acme raised 5 million with Foo Capital, Jane Doe."}, 0.82), ({"confidence": float("nan")}, 0.0), ({"confidence": 1.2}, 1.0), ({"confidence": -0.1}, 0.0),
])
def test_validation_penalties(spark, changes, confidence):
    assert round(judged(spark, **changes)["confidence"], 6) == confidence


def test_validation_corrects_classes(spark):
    body = "Acme raised $5 million led by Foo Capital for its token and trading business. Jane Doe founded it."
    assert judged(spark, startup_name="Uniswap", text=body)["category"] == "crypto" and judged(spark, startup_name="Uniswap")["category"] == "other"
    assert judged(spark, startup_name="Datingly", startup_description="for people")["category"] == "consumer_ai"
    assert judged(spark, startup_name="Robinhood", text=body)["category"] == "fintech"
    assert judged(spark, is_ai=False, is_enterprise=False, category="hardware")["category"] == "other"
    assert judged(spark, startup_name="How to Build a Startup")["verdict"] == "no announcement"
    assert judged(spark, round_label="bridge")["round_label"] == "unknown" and judged(spark, amount_usd=60 * M)["amount_review"]
    assert judged(spark, confidence=0.45)["verdict"] == "low confidence" and judged(spark, confidence=0.45, external=True)["verdict"] == "accepted"


def test_date_votes(spark):
    rows = [(1, 1, D(2026, 1, 5), 0.4), (1, 2, D(2026, 1, 9), 0.6), (1, 3, D(2026, 1, 6), 0.3), (2, 1, D(2026, 1, 1), 0.9), (2, 2, D(2026, 2, 1), 0.9)]
    got = {r["deal_id"]: r for r in merge.date_votes(spark.createDataFrame(rows, "deal_id long, seq long, date date, confidence double")).collect()}
    assert (got[1]["date"], round(got[1]["sure"], 6), got[1]["sources"]) == (D(2026, 1, 5), 0.8, 2) and got[2]["date"] == D(2026, 1, 1)


def test_best_filing(spark):
    deals = spark.createDataFrame([(1, "Acme Robotics", D(2026, 1, 10)), (2, "Nothing Like It", D(2026, 1, 10))], "deal_id long, name string, date date")
    filings = spark.createDataFrame([(1, "Acme Robotics Inc", D(2026, 1, 12), "D"), (2, "Acme Robotics", D(2024, 1, 1), "D/A"), (3, "Zeta", D(2026, 1, 10), "D")], "filing_id long, company string, filed date, form string")
    got = likeness.best_filing(deals, filings).collect()
    assert [(r["deal_id"], r["filing_id"], r["confident"]) for r in got] == [(1, 1, True), (2, 1, False)]  # the best of all, though no likely one


def test_merges(spark):
    amount = spark.createDataFrame([("undisclosed", "news", "$5M", "news"), ("$4M", "news", "$5M", "news"), ("$4M", "news", "$5M", "sec_form_d"), ("$4M", "sec_form_d", "$5M", "sec_form_d")], "o string, os string, n string, ns string")
    assert [r[0] for r in amount.select(merge.merged_amount(*(F.col(c) for c in ("o", "os", "n", "ns")))).collect()] == ["$5M", "$4M", "$5M", "$4M"]
    moved = merge.dense_positions(spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "g string, k int"), "g", "k").collect()
    assert sorted((r["g"], r["k"], r["position"]) for r in moved) == [("a", 5, 0), ("a", 9, 1), ("b", 1, 0)]


def test_export_reader(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿Company Name,Round,Money Raised,Date,Lead Investors,Investor Names\nAcme,Series B - Acme,12500000,"Dec 18, 2025","A, B","A, B, C, C"\n,seed,1,,,\nBeta,angel,-,31/12/2025,,\n', encoding="utf-8")
    got = {r["startup_name"]: r for r in exports.read_export(spark, str(tmp_path / "x.csv")).collect()}
    assert set(got) == {"Acme", "Beta"}
    a = got["Acme"]
    assert (a["round_type"], a["amount"], a["announced_date"], a["lead_investors"], a["participants"]) == ("series_b", "$12M", D(2025, 12, 18), ["A", "B"], ["C", "C"])
    assert (got["Beta"]["round_type"], got["Beta"]["amount"], got["Beta"]["announced_date"]) == ("pre_seed", None, D(2025, 12, 31))


def test_feed_reader(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T</title><link>http://a.b/c</link><pubDate>Thu, 18 Dec 2025 10:00:00 GMT</pubDate><description>&lt;p&gt;Hello&lt;/p&gt;</description></item><item><title>no link</title></item></channel></rss>")
    got = exports.read_feed(spark, str(tmp_path / "f.xml"), "feed").collect()
    assert [(r["title"], r["url"], r["published_date"], r["text"]) for r in got] == [("T", "http://a.b/c", D(2025, 12, 18), "Hello")]


def test_page_text(spark):
    page = "<html><head><script>x()</script><style>p{}</style></head><body><nav>menu</nav><h1>Title</h1><p>One &amp; two</p><!-- no --><footer>end</footer></body></html>"
    df = spark.createDataFrame([(page,), (None,)], "h string")
    assert [r[0] for r in df.select(exports.plain_text(F.col("h"))).collect()] == ["Title\nOne & two", ""]


def test_positions(spark):
    raw = spark.createDataFrame([(["abc", " F1 ", "X", "1", "2", "10.0", "50.0", "1000", "false", "100", "0"],), (["def", "F2", "X", "1", "2", None, "50.0", "1000", "false", "100", "0"],)], "state array<string>")
    got = exports.predicted(exports.states_of_snapshot(raw), F.lit(60.0)).collect()
    assert len(got) == 1 and got[0]["callsign"] == "F1" and abs(got[0]["lat"] - (50 + 1500 / 111_320)) < 1e-9 and got[0]["lon"] == 10


def streamed(spark, df, make, name, mode, tmp_path):
    path = str(tmp_path / name)
    df.write.parquet(path)
    stream = make(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path))
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_streams_agree_with_batches(spark, tmp_path):
    t = datetime.datetime
    articles = spark.createDataFrame([(t(2026, 1, 1, k), "same text" if k % 2 else f"text {k}", f"http://a.b/{k}?utm_source=x") for k in range(10)], "ts timestamp, text string, url string").coalesce(1)
    got = streamed(spark, articles, flows.unique_articles, "unique_articles", "append", tmp_path)
    assert len(got) == 6 and all("utm" not in r["normal_url"] for r in got)
    states = spark.createDataFrame([(k % 3, float(k), 0.0, 1.0, t(2026, 1, 1, k)) for k in range(9)], "icao long, lat double, lon double, altitude double, seen_at timestamp").repartition(3)
    last = {}
    for r in streamed(spark, states, flows.latest_positions, "latest_positions", "complete", tmp_path):
        last[r["icao"]] = r["lat"]
    assert last == {0: 6.0, 1: 7.0, 2: 8.0}


def test_stuck_scans(spark):
    now = datetime.datetime(2026, 1, 31, 12)
    ago = lambda s: now - datetime.timedelta(seconds=s)
    rows = [(1, "running", ago(900), ago(299)), (2, "running", ago(900), ago(301)), (3, "running", ago(301), None), (4, "success", ago(900), ago(900))]
    scans = spark.createDataFrame(rows, "scan_id long, status string, started_at timestamp, last_heartbeat timestamp")
    assert sorted(r["scan_id"] for r in flows.stuck_scans(scans, now).collect()) == [2, 3]


def test_registry_matches_are_those_of_all_pairs(spark):
    import random

    from ledgerloom.operators import registry

    r = random.Random(1)
    words = ["nova", "data", "labs", "ab", "x", "company", "novadata", "labsx", "inc"]
    pick = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 4)))
    filings, entities = [(k, pick().title()) for k in range(60)], [(k, pick()) for k in range(60)]
    got = {x["filing_id"]: x["entity_id"] for x in registry.match_entities(spark.createDataFrame(filings, "filing_id long, company string"), spark.createDataFrame(entities, "entity_id long, entity string")).collect()}
    expected = {}
    for f, name in filings:
        a = re.sub(r"\s*(inc\.?|llc|corp\.?|corporation|ltd\.?)$", "", name.lower()).strip()
        for e, b in entities:
            x, y = set(a.split()), set(b.split())
            if a and (a in b or b in a or len(x & y) >= min(2, len(x))):
                expected[f] = e
                break
    assert got == expected


def test_matching_names_are_those_of_all_pairs(spark):
    import random

    from ledgerloom.functions import fixed
    from ledgerloom.functions.names import normal_form

    r = random.Random(2)
    rows = [(k, r.choice(["Acme", "acme", "The Acme", "Zed", "Zedgo", "Acmelabs", "acme hq", "Acmely", "Ai", "???", "Foo"]) + r.choice(["", ", Inc.", "ai", "x"])) for k in range(80)]
    companies = spark.createDataFrame(rows, "company_id long, name string")
    norm = {x["company_id"]: (x["n"] or "=" + x["name"].lower().strip()) for x in companies.withColumn("n", normal_form(F.col("name"))).collect()}
    first = {}
    for k, n in sorted(norm.items()):
        first.setdefault(n, k)
    same = {("same", k, first[n]) for k, n in norm.items() if first[n] != k}
    suffix = {("suffix", i, j) for a, i in first.items() for b, j in first.items() if len(a) >= 3 and b.startswith(a) and b[len(a) :] in fixed.MATCH_SUFFIXES}
    assert {tuple(x) for x in resolve.matching_names(companies).collect()} == same | suffix and suffix


def best_of_all_pairs(deals, filings):
    import difflib

    out = {}
    for deal, name, day in deals:
        best = None
        for filing, company, filed, form in filings:
            if name is None or company is None:
                continue
            ratio = difflib.SequenceMatcher(None, name.lower(), company.lower()).ratio()
            gap = abs((filed - day).days) if day and filed else None
            near = 0.0 if gap is None else 0.3 if gap <= 7 else 0.2 if gap <= 30 else 0.1 if gap <= 90 else 0.0
            score = (ratio + near) + (0.1 if form == "D" else 0.0)
            if best is None or (score, -filing) > best[0]:
                best = (score, -filing), (deal, filing, round(score, 6), ratio > 0.8 and gap is not None and gap <= 30)
        if best:
            out[deal] = best[1]
    return out


DEALS, FILINGS = "deal_id long, name string, date date", "filing_id long, company string, filed date, form string"


def test_best_filing_is_that_of_all_pairs(spark, monkeypatch):
    import random

    monkeypatch.setattr(likeness, "BLOCK", 16)
    r = random.Random(7)
    words = ["nova", "acme", "robotics", "data", "labs", "health", "orbit", "zeta", "quantum", "ai", "Éclair", "日本"]

    def name():
        made = " ".join(r.choice(words) for _ in range(r.randint(1, 3))) + r.choice(["", "", " Inc", ", Inc.", " Company"])
        k = r.randrange(len(made))
        return made[:k] + made[k + 1 :] if r.random() < 0.3 else made.upper() if r.random() < 0.1 else made

    day = lambda: None if r.random() < 0.15 else D(2024, 1, 1) + datetime.timedelta(r.randint(0, 900))
    filings = [(100 + k, name(), day(), r.choice(["D", "D", "D/A", None])) for k in range(220)]
    filings += [(k, "hot name", D(2025, 5, 5), "D/A") for k in range(400, 440)] + [(500, "", day(), "D"), (501, None, day(), "D"), (502, "x" * 400, None, "D/A")]
    deals = [(k, name(), day()) for k in range(200)] + [(300 + k, "hot name", D(2025, 5, 7)) for k in range(40)]
    deals += [(400, "", None), (401, None, D(2025, 1, 1)), (402, "Nova Rbotics", D(2024, 2, 2)), (403, "@@@@", None), (404, "x" * 390, None), (405, filings[3][1], D(1990, 1, 1))]
    got = likeness.best_filing(spark.createDataFrame(deals, DEALS), spark.createDataFrame(filings, FILINGS)).collect()
    assert {x["deal_id"]: tuple(x) for x in got} == best_of_all_pairs(deals, filings) and len(got) == len(deals) - 1
    assert likeness.best_filing(spark.createDataFrame(deals, DEALS), spark.createDataFrame([], FILINGS)).count() == 0


def test_best_filings_of_the_whole_tables(spark):
    from ledgerloom import plans
    from ledgerloom.plans import extraction, views

    folder = "/root/testdata/sf0.001"
    if not pathlib.Path(folder).exists():
        pytest.skip("test tables are not here")
    v = views.Views(spark, folder)
    deals = [tuple(x) for x in v.deals.join(v.companies, "company_id").select("deal_id", "name", "announced_date").collect()]
    filings = [(x["company_id"], x["name"], extraction.AS_OF - datetime.timedelta(x["company_id"] % 2000), "D") for x in v.companies.collect()]
    assert {x["deal_id"]: tuple(x) for x in plans.QUERIES["enr02_best_filings"](spark, folder).collect()} == best_of_all_pairs(deals, filings)


def test_atom_reader(spark, tmp_path):
    from ledgerloom.sources import landed

    (tmp_path / "a.xml").write_text('<feed><entry><title>T</title><link href="http://a.b/c"/><updated>2025-12-18T10:00:00Z</updated><summary>&lt;b&gt;Hi&lt;/b&gt;</summary></entry><entry><title>none</title></entry></feed>')
    got = landed.read_atom(spark, str(tmp_path / "a.xml"), "feed").collect()
    assert [(x["source"], x["title"], x["url"], x["published_date"], x["text"]) for x in got] == [("feed", "T", "http://a.b/c", D(2025, 12, 18), "Hi")]


def test_long_articles_keep_signs_of_funding(spark):
    from ledgerloom.functions.text import shortened

    body = "a" * 5000 + " raised $5 million in a Series A led by Foo " + "b" * 5000
    out = spark.createDataFrame([(body,), ("short",), (None,)], "t string").select(shortened("t").alias("t")).collect()
    assert out[1]["t"] == "short" and out[2]["t"] is None
    assert out[0]["t"].startswith("a" * 2800) and "raised $5 million" in out[0]["t"] and out[0]["t"].endswith("[TRUNCATED]") and len(out[0]["t"]) <= 4012


def test_plans_import_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 200 and set(o) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(__file__).resolve().parent.parent).returncode == 0


def test_deep_and_open_pages():
    from ledgerloom.sources import markup

    deep = markup.tree("<div>" * 100_000 + "inside" + "</span>" * 1000)
    assert deep.text() == "inside" and sum(1 for _ in deep.every()) == 100_000
    page = markup.tree("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>" + "<p>x" * 50_000 + "<div>y</div><table><tr><td>1<td>2<tr><td>3</table>")
    assert [e.text() for e in page.find("li")] == ["a", "bc", "c", "d"]
    assert [e.text() for e in page.find("td")] == ["1", "2", "3"] and len(page.find("tr")) == 2
    assert all(e.parent.tag == "" for e in page.find("p")) and page.find("div")[0].parent.tag == ""
    assert [e.text() for e in markup.tree("<table><tr><td><p>a<table><tr><td>b</table>c</table>").find("td")] == ["abc", "b"]


def test_deals_of_one_name_meet_filings_as_one(spark, monkeypatch):
    """Names are compared once for all their days: pairs of blocks grow with names, not with deals and filings."""
    from tests.test_saving import rows_of

    monkeypatch.setattr(likeness, "BLOCK", 4)
    name = lambda k: f"{'abcdefghij'[k % 10] * 3} company {k % 10}"
    deals = [(k, name(k), D(2024, 1, 1) + datetime.timedelta(k // 10)) for k in range(3000)]
    filings = [(k, name(k), D(2024, 1, 1) + datetime.timedelta(k // 10 * 3), "D/A") for k in range(1000)]
    before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    got = likeness.best_filing(spark.createDataFrame(deals, DEALS), spark.createDataFrame(filings, FILINGS)).collect()
    assert len(got) == 3000 and all(r["filing_id"] % 10 == r["deal_id"] % 10 and r["score"] == 1.3 for r in got)
    assert 0 < rows_of(spark, before) < 50_000


def test_names_are_compared_only_for_days_with_filings_of_their_own(monkeypatch):
    """Many names alike, each filed on a day of its own: a deal is held against those filed around it, not against all of them."""
    import numpy as np

    companies = [f"company {k}, inc." for k in range(1000)]
    names, days = [f"company {k} labs" for k in range(20)], [np.array([k * 18, k * 18 + 5]) for k in range(20)]
    filed, ids, form = [np.array([k % 360]) for k in range(1000)], [np.array([k]) for k in range(1000)], np.full(1000, 0.1)
    ran = []
    monkeypatch.setattr(likeness, "likeness", lambda a, b, to=likeness.likeness: ran.append((a, b)) or to(a, b))
    got = {row[:2]: row[2:] for rows in likeness.best_near(names, days, [np.zeros(2)] * 20, 0, companies, filed, form, ids) for row in rows}
    compared = len(set(ran))
    for name, mine in zip(names, days, strict=True):
        for day in mine.tolist():
            scores = [(likeness.likeness(name, c) + add + 0.1, -k, likeness.likeness(name, c)) for k, c in enumerate(companies) if (add := next((add for gap, add in likeness.NEAR if abs(k % 360 - day) <= gap), None))]
            score, k, alike = max(scores)
            assert got[name, day] == (-k, alike, pytest.approx(score))
    assert 0 < compared < 20 * 100  # of 20 * 1000


def test_matching_blocks_and_subsequences_are_those_of_plain_ways():
    import difflib
    import random

    import numpy as np

    r = random.Random(3)
    for turn in range(3000):
        some = lambda: "".join(r.choice("abé😀 "[: r.randint(1, 5)]) for _ in range(r.randint(0, r.choice([6, 25, 90, 210]))))
        a, others = some(), [some() for _ in range(3)]
        assert [likeness.likeness(a, b) for b in others] == [difflib.SequenceMatcher(None, a, b).ratio() for b in others]
        if turn % 10 == 0:
            others.append("b" * 1100 + a)  # longer than the columns
            assert likeness.Companies(others).in_order(a, np.arange(4)).tolist() == [likeness.common_in_order(likeness.places(a), len(a), b) for b in others]


def test_best_filings_of_long_names(spark):
    import random

    r = random.Random(11)
    name = lambda: " ".join(r.choice(["nova robotics", "acme data labs", "orbit health", "zeta quantum"]) for _ in range(r.choice([1, 5, 7, 19])))
    day = lambda: D(2024, 1, 1) + datetime.timedelta(r.randint(0, 400))
    filings, deals = [(k, name(), day(), r.choice(["D", "D/A"])) for k in range(60)], [(k, name()[1:], day()) for k in range(60)]
    got = likeness.best_filing(spark.createDataFrame(deals, DEALS), spark.createDataFrame(filings, FILINGS)).collect()
    assert {x["deal_id"]: tuple(x) for x in got} == best_of_all_pairs(deals, filings)


def test_page_texts_are_made_a_few_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from ledgerloom.sources import exports

    pages = pa.array([f"<p>{k}</p>" + "<b>word</b>" * 2000 for k in range(400)] + [None])
    tracemalloc.start()
    texts = exports.page_texts(pages, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(texts) == 401 and texts[7].as_py() == "\n".join(["7"] + ["word"] * 2000) and texts[400].as_py() == ""
    assert peak < 2_000_000  # all texts are 4 MB, all pages 9 MB
