"""Scalar functions on literal cases."""

import datetime
import itertools
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, classify, dates, fixed, funds, keys, names, scoring, text, urls

AS_OF = datetime.date(2026, 1, 31)


def each(spark, values, expression, kind="string"):
    """The expression over a column ``x``, in order."""
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r["y"] for r in df.select("k", expression(F.col("x")).alias("y")).orderBy("k").collect()]


def pairs(spark, values, expression):
    df = spark.createDataFrame([(k, *v) for k, v in enumerate(values)], "k int, a string, b string")
    return [r["y"] for r in df.select("k", expression(F.col("a"), F.col("b")).alias("y")).orderBy("k").collect()]


def check(spark, cases, expression, kind="string"):
    got = each(spark, [a for a, _ in cases], expression, kind)
    assert got == [b for _, b in cases], [(c, g) for c, g in zip(cases, got, strict=True) if c[1] != g]


def test_amounts(spark):
    check(spark, [
        ("$30 million", 30_000_000), ("$30mn", 30_000_000), ("$2.5B", 2_500_000_000), ("$500K", 500_000), ("€100 million", 100_000_000), ("£50M", 50_000_000), ("$25-30 million", 25_000_000),
        ("25 to 30 million", 25_000_000), ("approximately $50M", 50_000_000), (None, None), ("", None), ("<UNKNOWN>", None), ("undisclosed", None), ("₹97 crore", 11_688_500), ("50", 50_000_000), ("5000", 5000), ("5000000", 5_000_000), ("US $4M", 4_000_000),
    ], amounts.parsed)
    check(spark, [("$5M", 5_000_000), ("$2-5M", 2_000_000), ("$0.5b", 500_000_000), ("$750k", 750_000), ("$", 0), ("undisclosed", 0), (None, 0)], amounts.lower_bound)
    check(spark, [("50M", True), ("USD 50 million", True), ("Amount not mentioned", False), ("undisclosed 5", False), ("N/A", False), (None, False)], amounts.is_real)
    check(spark, [(47_500_000, "$47.5M"), (50_000_000, "$50M"), (1_500_000_000, "$1.5B"), (500_000, "$500,000"), (1_005_000_000, "$1.01B")], amounts.exact, "long")
    check(spark, [(249_999, None), (250_000, 1), (500_000, 2), (4_000_000, 6), (5_000_000, 6), (6_000_000, 7), (40_000_000, 11), (50_000_000, 11), (60_000_000, 12), (300_000_000, 17), (399_000_000, 17), (2_000_000_000, 28)], amounts.bucket, "long")


def test_company_names(spark):
    check(spark, [
        ("Torq, Inc.", "torq"), ("Protege Labs", "protege"), ("Tech Corp", "tech"), ("The Company", "company"), ("The AI Lab", "ai"), ("Open-AI", "openai"), ("X.AI", "xai"), ("AI & ML Corp", "ai"), ("Converge Bio", "converge"),
        ("OpenAI Technologies", "openai"), ("The AI Company, Inc.", "ai"), ("Acme Labs AI", "acme"), ("Meta Data", "meta"), ("  Foo ", "foo"),
    ], names.normal_form)
    match = lambda a, b: names.names_match(a, b, names.normal_form(a), names.normal_form(b))
    same = [("Ramp", "Ramp Labs"), ("Valerie", "Valerie Health"), ("AI Corp", "ai corp"), ("Glean", "GleanHQ")]
    other = [("Amazon", "Amazonia"), ("OpenAI", "OpenAPI"), ("Meta", "Metadata"), ("Foo", "")]
    assert pairs(spark, same + other, match) == [True] * len(same) + [False] * len(other)


def test_names_that_match_share_a_block(spark):
    values = ["Ramp", "Ramphq", "Valerie Health", "Valerie", "Gleanai", "Glean", "abio", "ab"]
    blocks = dict(zip(values, each(spark, values, lambda x: names.block_keys(names.normal_form(x))), strict=True))
    assert set(blocks["Ramp"]) & set(blocks["Ramphq"]) and set(blocks["Gleanai"]) & set(blocks["Glean"]) and not set(blocks["abio"]) & set(blocks["ab"])


def test_titles_and_people(spark):
    check(spark, [("How to Build a Startup", True), ("This Is A Very Long Name", True), ("AB", True), ("", True), (None, True), ("OpenAI", False), ("Tech Labs Inc", False), ("Big Data Analytics", False), ("The Trade Desk", False), ("America's Construction Problem", True)], names.looks_like_title)
    assert pairs(spark, [("John A Smith", "John B Smith"), ("James Smith", "James Johnson"), ("", "John"), ("Jon", "Jonathan Roe")], names.person_names_match) == [True, False, False, True]
    check(spark, [("Hot  Leads-2026!", "hot_leads_2026"), ("!!!", "column"), (" A b ", "a_b")], names.slug)


def test_urls(spark):
    check(spark, [("https://Ex.com/a/?utm_source=t&id=1#f", "https://ex.com/a?id=1"), ("http://a.B/c/", "http://a.b/c"), ("http://a.b?x=1&REF=2&y=", "http://a.b?x=1&y=")], urls.normalised)
    check(spark, [("https://acme.io", True), ("www.acme.io", True), ("https://github.com/x", False), ("https://twitter.com/x", False), ("not mentioned", False), (None, False), ("ftp://a.b", False)], urls.is_website)
    check(spark, [("https://linkedin.com/in/bob-w", True), ("https://linkedin.com/in/ab", False), ("https://linkedin.com/company/ab", False)], urls.is_profile)
    check(spark, [("https://www.linkedin.com/company/ab", True), ("https://linkedin.com/company/a", False)], urls.is_company_page)
    check(spark, [("www.example.com", "https://www.example.com"), ("Not mentioned", None), ("http://example.com", "https://example.com")], urls.sanitised)


def test_dates_and_keys(spark):
    day = datetime.date
    check(spark, [(day(2026, m, 1), m in (1, 4, 7, 10)) for m in range(1, 13)] + [(day(2026, 1, 2), False)], dates.is_placeholder, "date")
    check(spark, [("3 days ago", day(2026, 1, 28)), ("2 weeks ago", day(2026, 1, 17)), ("1 month ago", day(2026, 1, 1)), ("1 year ago", day(2025, 1, 31)), ("yesterday", day(2026, 1, 30)), ("today", AS_OF), ("soon", None)], lambda x: dates.relative(x, AS_OF))
    check(spark, [("on 2025-12-18", day(2025, 12, 18)), ("Dec 18, 2025", day(2025, 12, 18)), ("18 December 2025", day(2025, 12, 18)), ("12/18/2025", day(2025, 12, 18)), ("2025-13-45", None), ("x", None)], dates.absolute)
    check(spark, [("5 hours ago", AS_OF), ("2 days ago", day(2026, 1, 29)), (None, AS_OF)], lambda x: dates.search_age(x, AS_OF))
    check(spark, [(day(2026, 1, 21), 6824), (day(2026, 1, 22), 6825), (day(1969, 12, 31), -1)], keys.day_bucket, "date")
    one = each(spark, [day(2026, 1, 22), None], lambda d: keys.dedup_key(F.lit("Torq, Inc."), F.lit("seed"), d, AS_OF), "date")
    import hashlib

    assert one == [hashlib.md5(b"torq|seed|6825").hexdigest(), hashlib.md5(f"torq|seed|nodate_{(AS_OF - day(1970, 1, 1)).days // 30}".encode()).hexdigest()]


def test_texts(spark):
    import hashlib

    long = "word " * 300
    squeezed = long.strip()
    check(spark, [("", ""), (None, ""), ("a \n  b", hashlib.md5(b"a b").hexdigest()), (long, hashlib.md5((squeezed[:500] + squeezed[-200:]).encode()).hexdigest())], text.content_fingerprint)
    check(spark, [("Acme raises $5M", True), ("Big round for investor", True), ("Funding", False), ("", True), (None, True)], classify.likely_funding)
    check(spark, [("Year in Review", True), ("Acme raises", False), (None, False)], classify.no_announcement)
    check(spark, [("raised 5 million", True), ("raised", False), ("raised raised raised", True), ("nothing", False)], text.likely_funding_content)


@pytest.mark.parametrize(("name", "description", "body", "reason"), [
    ("Farcaster", "", "", "known"), ("0xMiden", "", "", "name"), ("Data Protocol", "", "", "name word"), ("Foo", "a blockchain", "", "description"), ("Foo", "a blockchain for nlp", "", None),
    ("Foo", "", "token staking bridge dao", "density"), ("Foo", "", "token staking bridge dao llm", None), ("Foo", "", "a web3 startup", "label"), ("Acme", "cloud", "plain", None),
])
def test_crypto(spark, name, description, body, reason):
    df = spark.createDataFrame([(name, description, body)], "n string, d string, t string")
    assert df.select(classify.crypto(F.col("n"), F.col("d"), F.col("t"), F.lit(None).cast("string"), F.array(F.lit("Foo")))).collect()[0][0] == reason


@pytest.mark.parametrize("words", [["token", "tokenomics", "tok"], ["tokenomics", "token", "a.b", "a$"], ["led", "leads", "co-led", "[x]"], ["m", "mn", "million", "é"], ["gas fee"]])
def test_keyword_patterns_find_what_the_plain_list_finds(spark, words):
    plain = re.compile("|".join(map(re.escape, words)))
    texts = ["".join(t) for t in itertools.product(["token", "omics", "co-led", "a.b", "axb", "mn", "é", "gas fee", " "], repeat=3)]
    found = lambda x: F.struct(text.has_any(x, words), text.count_matches(x, words))
    assert [tuple(r) for r in each(spark, texts, found)] == [(bool(n), n) for n in (len(plain.findall(t)) for t in texts)]


def test_lead_language(spark):
    words = ["led by", "led the", "lead ", "leads ", "leading", "co-led", "co-lead", "co-leads", "headed by", "lead investor", "spearheaded", "fled by", "pled the", "misleading", "ledby", "leader", "a headed  by"]
    check(spark, [(w, bool(re.search(fixed.LEAD_LANGUAGE, w))) for w in words], funds.lead_language)


def test_background_mentions(spark):
    body = "x" * 900
    cases = [("Acme " + body, False, False), (body + " Acme", False, True), ("short", False, False), (body + " Acme", True, False), ("", False, False)]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t string, e boolean, y boolean").orderBy("k")
    assert all(r["got"] == r["y"] for r in df.select("y", classify.background_mention(F.lit("Acme"), F.col("t"), F.col("e")).alias("got")).collect())


def test_funds(spark):
    check(spark, [("Felicis Ventures", "felicis"), ("Andreessen Horowitz", "a16z"), ("Benchmark International", None), ("GV", "gv"), ("Accel and Sequoia", "accel"), ("Accelerate", None), ("a16z crypto", None), (None, None)], funds.matched_fund)
    body = "funded by gv and index.html of sequoia. see a16z.com"
    check(spark, [("GV", True), ("Index", False), ("Sequoia Capital", True), ("a16z", False), ("Nobody Inc", False)], lambda x: funds.named_in(x, F.lit(body)))


def test_scores(spark):
    row = spark.createDataFrame([("DE", True, True, 10_000_000, True, True, True)], "s string, f boolean, t boolean, a long, u boolean, g boolean, n boolean")
    score = scoring.filing_match(*(F.col(c) for c in "sftaugn"))
    assert row.select(score, scoring.filing_label(score)).collect()[0][:] == (22, "HIGH")
    entity = spark.createDataFrame([("Acme AI Labs", "Stripe Atlas", AS_OF - datetime.timedelta(10))], "n string, a string, d date")
    assert entity.select(scoring.entity(F.col("n"), F.col("a"), F.col("d"), AS_OF)).collect()[0][0] == 12
