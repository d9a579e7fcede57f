"""Profiles, websites, job posts, registry and trademark results: cases with the results that they must have."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, dates, people, text
from ledgerloom.plans.predicates import varied
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import Views


def cases(*rows: tuple) -> tuple:
    """Functions that give columns of inputs by id, and the SQL of the last element of each row, which is the result."""
    inputs = [varied("id", [r[k] for r in rows])[0] for k in range(len(rows[0]) - 1)]
    shown = lambda x: "NULL" if x is None else f"DATE '{x}'" if isinstance(x, datetime.date) else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return *inputs, f"(CASE id % {len(rows)} " + " ".join(f"WHEN {k} THEN {shown(r[-1])}" for k, r in enumerate(rows)) + " END)"


_TITLE, _TITLE_SQL = cases(
    ("John Smith - CEO at Company | LinkedIn", "John Smith"), ("Jane Q. Doe, CTO at Foo", "Jane Q. Doe"), ("Anna Wang: Founder & CEO", "Anna Wang"), ("Tom Baker CEO", "Tom Baker"), ("CEO and Founder - John Smith", None),
    ("john smith ceo", None), ("Sales Team | Acme", "Sales Team"), ("Global Services", None), ("Élan Vital – partner", "Élan Vital"), ("LinkedIn", None), ("Madonna", None), ("Wolfeschlegelstein Hausen", None),
)


@query(f"SELECT id, {_TITLE_SQL} AS person FROM landed_rows")
def str06_title_names(v: Views) -> DataFrame:
    return v.landed_rows.select("id", people.name_of_title(_TITLE()).alias("person"))


_PROFILE, _EXPECTED, _SAME_SQL = cases(
    ("Bedrock Data", "Bedrock", True), ("Acme, Inc.", "acme", True), ("Nova AI", "Nova", True), ("Zeta", "Omega", False), ("Graphitte", "Graphite", True), ("", "Acme", False), (None, "Acme", False), ("Foo-Bar Corp", "foobar", True),
    ("Delta Works LLC", "Epsilon Works LLC", False),
)


@query(f"SELECT id, {_SAME_SQL} AS same FROM landed_rows")
def str09_profile_companies(v: Views) -> DataFrame:
    return v.landed_rows.select("id", people.same_company(_PROFILE(), _EXPECTED()).alias("same"))


_RESULT, _SNIPPET, _FIRM, _KNOWN, _VALID_SQL = cases(
    ("John Smith - CEO at Acme | LinkedIn", "", "Acme", None, True), ("John Smith - Engineer at Acme", "", "Acme", None, False), ("John Smith", "Founder @ Acme Labs. More", "Acme", None, True), ("John Smith - CEO at Other", "", "Acme", None, False),
    ("John Smith", "works at Acme", "Acme", "Co-Founder", True), ("John Smith", "works at Acme", "Acme", "Engineer", False), ("Nobody", "", "Acme", "CEO", False),
)


@query(f"SELECT id, {_VALID_SQL} AS valid FROM landed_rows")
def enr10_valid_founders(v: Views) -> DataFrame:
    """Profiles that are those of a company's leaders (APX-19 parses them)."""
    facts = people.profile_facts(_RESULT(), _SNIPPET(), _KNOWN())
    return v.landed_rows.select("id", people.valid_founder(facts, _FIRM()).alias("valid"))


_LINKED, _LINK_SQL = cases(
    ("see http://linkedin.com/in/jane-doe now", "https://linkedin.com/in/jane-doe"), ("https://www.linkedin.com/in/malpostings", None), ("https://linkedin.com/in/ab", None), ("unknown https://linkedin.com/in/jane-doe", None),
    ("https://linkedin.com/company/acme", None), ("none", None), ("https://www.linkedin.com/in/shresthakukreja/", "https://www.linkedin.com/in/shresthakukreja"),
)
_PAGED, _PAGED_SQL = cases(
    ("at http://www.linkedin.com/company/acme", "https://www.linkedin.com/company/acme"), ("https://linkedin.com/company/acme/jobs", None), ("https://linkedin.com/company/a", None), ("https://linkedin.com/company/acme/ more", "https://linkedin.com/company/acme"),
)


@query(f"SELECT id, {_LINK_SQL} AS profile, {_PAGED_SQL} AS page FROM landed_rows")
def apx17_links(v: Views) -> DataFrame:
    return v.landed_rows.select("id", people.profile_link(_LINKED()).alias("profile"), people.company_link(_PAGED()).alias("page"))


_SITE, _OF, _SITE_SQL = cases(
    ("https://www.acme.io/x", "Acme", True), ("https://github.com/acme", "Acme", False), ("https://acme.ru", "Acme", False), ("https://gv.com", "GV", True), ("https://gvx.com", "GV", False), ("https://graphitehealth.io", "Graphite", False),
    ("https://carehealth.io", "Care", True), ("https://traderepublic.com", "Trade Republic", True), ("https://tradingview.com", "Trade Republic", False), ("https://tradeview.com", "Trade Republic", True), ("https://torq.co", "The Torq Company", True),
    ("https://miden.co", "0xMiden", False), ("acme.io", "Acme", False), (None, "Acme", False), ("https://acme.io", " ", False), ("https://nova.dev", "Nova Data Labs", True), ("https://medical-nova.com", "Nova Works", False),
)


@query(f"SELECT id, {_SITE_SQL} AS site FROM landed_rows")
def cls15_startup_sites(v: Views) -> DataFrame:
    return v.landed_rows.select("id", people.startup_site(_SITE(), _OF()).alias("site"))


_POST, _POST_SQL = cases(
    ("Founding Engineer at Acme | LinkedIn", "Acme"), ("Engineer at Beta at Remote", "Beta"), ("Engineer - TechCorp - Remote", "TechCorp"), ("Hiring: DevOps", "DevOps"), ("Hiring: Work at Zorn", "Zorn"), ("Role at Boston - Qed", "Qed"),
    ("Role at Berlin", "Role at Berlin"), ("x" * 60, "x" * 50 + "..."), ("Short", "Short"), ("Engineer - Remote", "Engineer - Remote"),
)
_BODY, _BODY_SQL = cases(("in stealth mode", True), ("no longer stealth", False), ("a recently funded startup", True), ("plain", False), ("emerged from stealth and pre-launch", False))


@query(f"SELECT id, {_POST_SQL} AS company, {_BODY_SQL} AS stealth FROM landed_rows")
def cls12_job_posts(v: Views) -> DataFrame:
    return v.landed_rows.select("id", people.job_company(_POST()).alias("company"), people.stealth_post(F.lit("Engineer"), _BODY()).alias("stealth"))


_RTITLE, _RTEXT, _REG_SQL = cases(
    ('News of "Quantum Labs" today', "", "Quantum Labs"), ("Nova Data Technologies files", "", "Nova Data Technologies"), ("all about it", "the startup Zephyr builds a data platform", "Zephyr"), ("lower case - Delaware Division", "a software shop", "lower case"),
    ("Nothing Here", "plain words", None), ("x - Filing", "cloud", None), ("a company Kestrel", "machine tools", "Kestrel"),
)


@query(f"SELECT id, {_REG_SQL} AS entity_name, CASE WHEN {_REG_SQL} IS NOT NULL THEN contains(body, 'clerky') END AS agent FROM (SELECT id, CASE WHEN id % 2 = 0 THEN 'by clerky' ELSE '' END AS body FROM landed_rows)")
def cls17_registry_results(v: Views) -> DataFrame:
    found = people.registry_result(_RTITLE(), F.concat(_RTEXT(), F.when(F.col("id") % 2 == 0, " by Clerky").otherwise("")))
    return v.landed_rows.select("id", found["entity_name"].alias("entity_name"), found["has_startup_agent"].alias("agent"))


_MTITLE, _MARK_SQL = cases(("NOVA AI - USPTO filing", "NOVA AI"), ("Trademark Application Zed", "Zed"), ("USPTO", None), ("Q", None), ("m" * 120, "m" * 100))


@query(f"SELECT id, {_MARK_SQL} AS mark_text, CASE WHEN {_MARK_SQL} IS NOT NULL THEN lpad(CAST(id AS VARCHAR), 8, '7') END AS serial_number FROM landed_rows")
def src17_trademark_results(v: Views) -> DataFrame:
    found = people.trademark_result(F.concat(F.lit("https://uspto.gov/"), F.lpad(F.col("id").cast("string"), 8, "7")), _MTITLE(), F.lit("class 99999999"))
    return v.landed_rows.select("id", found["mark_text"].alias("mark_text"), found["serial_number"].alias("serial_number"))


_HEADLINE, _AMOUNT_SQL = cases(("Acme gets €50M today", "€50M"), ("Foo lands $1.5 billion", "$1.5 b"), ("A 30m round", "30m round"), ("raises $40,000,000", None), ("nothing", None), ("gets $5million", "$5million"), ("£2.5 Million", "£2.5 M"))


@query(f"SELECT id, {_AMOUNT_SQL} AS amount FROM (SELECT id FROM landed_rows WHERE id % 7 NOT IN (1, 6)) UNION ALL SELECT id, CASE id % 7 WHEN 1 THEN '$1.5 billion' ELSE '£2.5 Million' END FROM landed_rows WHERE id % 7 IN (1, 6)")
def str12_headline_amounts(v: Views) -> DataFrame:
    return v.landed_rows.select("id", people.headline_amount(_HEADLINE()).alias("amount"))


_SIGNAL, _SIGNAL_SQL = cases(
    ("GitHub Trending: acme/tool (+5 stars)", "acme/tool"), ("YC W24: Nova - data", "Nova"), ("Delaware Filing: Zeta Data Inc", "Delaware Filing"), ("Acme – a tool", "Acme"), ("A", "A"), ("Plain Name", "Plain Name"), ("x: y", "x: y"),
)


@query(f"SELECT id, {_SIGNAL_SQL} AS company FROM landed_rows")
def str13_signal_companies(v: Views) -> DataFrame:
    return v.landed_rows.select("id", people.signal_company(_SIGNAL()).alias("company"))


_PAID, _PAID_SQL = cases(
    ("$50M", 50_000_000), ("$1.5B", 1_500_000_000), ("approximately $20 million", 20_000_000), ("5000", 5000), ("7", 7_000_000), ("raised over 3.25 mn", 3_250_000), ("undisclosed", None), (None, None), ("$2,500,000", 2_500_000), ("€40m", 40_000_000), ("...", None),
)


@query(f"SELECT id, CAST({_PAID_SQL} AS BIGINT) AS usd FROM landed_rows")
def amt02_extracted_amounts(v: Views) -> DataFrame:
    return v.landed_rows.select("id", amounts.extracted(_PAID()).alias("usd"))


_NOW = datetime.date(2026, 1, 31)
_QUOTE, _QUOTE_SQL = cases(
    ("On Dec 15, 2025 it said", datetime.date(2025, 12, 15)), ("15 December 2025", datetime.date(2025, 12, 15)), ("2025-11-02 and Jan 3, 2019", datetime.date(2025, 11, 2)), ("12/31/2025", datetime.date(2025, 12, 31)), ("12-31-2025", datetime.date(2025, 12, 31)),
    ("Feb 30, 2025", None), ("Mar 1, 2026", None), ("2019-01-01", None), ("soon", None), (None, None),
)


@query(f"SELECT id, {_QUOTE_SQL} AS day FROM landed_rows")
def date04_snippet_dates(v: Views) -> DataFrame:
    return v.landed_rows.select("id", dates.of_snippet(_QUOTE(), _NOW).alias("day"))


@query("SELECT id, md5('news:pw:' || CAST(20 + id % 2 AS VARCHAR) || ':' || title) AS cache_key FROM landed_rows WHERE id % 5 <> 0 OR score >= 200")
def str05_cached_searches(v: Views) -> DataFrame:
    """Keys of cached searches, without the entries older than four hours."""
    rows = v.landed_rows.withColumn("age_minutes", F.when((F.col("id") % 5 == 0) & (F.col("score") < 200), 240).otherwise(239))
    return rows.where("age_minutes < 240").select("id", text.cache_key(F.lit("news"), F.lit("pw"), (F.col("id") % 2 + 20), F.col("title")).alias("cache_key"))


@query("""SELECT id, CASE WHEN n <= 4000 THEN n ELSE 2800 + CASE WHEN id % 2 = 0 THEN 5 + 210 ELSE 0 END + 12 END AS length FROM (SELECT id, 2000 + id * 97 % 5000 + 5000 * (id % 3) AS n FROM landed_rows)""")
def cls18_shortened_articles(v: Views) -> DataFrame:
    """Lengths of articles after shortening: the head, what stands around "series A" in every other one, and a mark."""
    n = F.lit(2000) + F.col("id") * 97 % 5000 + 5000 * (F.col("id") % 3)
    sign = F.when((F.col("id") % 2 == 0) & (n > 4000), F.lit("; pre-seed round ;")).otherwise("")
    whole = F.concat(F.repeat(F.lit("x"), F.lit(2900)), sign, F.expr("repeat('y', int(2000 + id * 97 % 5000 + 5000 * (id % 3) - 2900))"))
    short = F.expr("repeat('x', int(2000 + id * 97 % 5000 + 5000 * (id % 3)))")
    article = F.when(n > 4000, F.substring(whole, F.lit(1), n.cast("int"))).otherwise(short)
    return v.landed_rows.select("id", F.char_length(text.shortened(article)).cast("long").alias("length"))
