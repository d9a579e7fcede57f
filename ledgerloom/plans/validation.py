"""Validation of extracted deals: cases, and what every step must make of them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import validate
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import Views

_D = datetime.date
TODAY = _D(2026, 1, 31)
_TEXT = "Acme raised $5 million in a seed round led by Accel. Jane Doe founded it."
_SAYS = "{} raised $5 million led by Accel, says Jane Doe."

BASE = {
    "text": _TEXT, "external": False, "startup_name": "Acme", "startup_description": "b2b software", "round_label": "seed", "amount_usd": 5_000_000, "category": "vertical_saas", "is_ai": True, "is_enterprise": True,
    "announcement": True, "confidence": 0.9, "snippet": "led by Accel", "lead_investors": ["Accel"], "participants": [], "founders": ["Jane Doe"], "tracked_fund": "Accel", "source_name": "techcrunch", "source_url": "https://x.y",
    "evidence": "said so", "round_date": _D(2026, 1, 10), "published_date": None,
}
SCHEMA = (
    "text string, external boolean, startup_name string, startup_description string, round_label string, amount_usd long, category string, is_ai boolean, is_enterprise boolean, announcement boolean, confidence double, snippet string, "
    "lead_investors array<string>, participants array<string>, founders array<string>, tracked_fund string, source_name string, source_url string, evidence string, round_date date, published_date date"
)
RESULT = {
    "verdict": "accepted", "confidence": 0.9, "band": "0.65 and over", "category": "vertical_saas", "is_ai": True, "is_enterprise": True, "lead_status": "confirmed_lead", "tracked_fund": "Accel", "round_label": "seed",
    "amount_review_reason": None, "round_date": _D(2026, 1, 10), "reextract_reason": None,
}
_STUB = {"verdict": "no announcement", "band": "below 0.35", "category": "not_ai", "is_ai": False, "is_enterprise": False, "lead_status": "none", "tracked_fund": None, "round_label": "unknown", "round_date": None}

#: What differs from the base, what differs in the result, and the counter that counts it, with its number.
CASES: list[tuple[dict, dict, tuple[str, int] | None]] = [
    ({}, {}, None),
    ({"confidence": 0.45}, {"confidence": 0.45, "verdict": "low confidence", "band": "below 0.50"}, None),
    ({"confidence": 0.45, "source_name": "google_news"}, {"confidence": 0.45, "band": "below 0.50"}, None),
    ({"text": "The weather is fine today in all towns."}, _STUB | {"confidence": 0.05}, None),
    ({"source_url": "https://coindesk.com/a"}, _STUB | {"confidence": 0.15}, None),
    ({"startup_name": "Modern Industrials"}, {"verdict": "no announcement"}, ("company_name_rejected", 1)),
    ({"startup_name": "Accel Fund III, LP"}, {"verdict": "no announcement"}, ("fund_raise_rejected", 1)),
    ({"round_label": "bridge"}, {"round_label": "unknown"}, ("round_type_corrected", 1)),
    ({"lead_investors": ["Zzzz One"]}, {"confidence": 0.85, "lead_status": "none", "tracked_fund": None}, ("investors_removed", 1)),
    ({"founders": ["A Bcd", "Efg Hij", "Klm Nop"]}, {"confidence": 0.81}, ("founders_removed", 3)),
    ({"snippet": None}, {"confidence": 0.82, "reextract_reason": "weak lead"}, ("lead_evidence_downgraded", 1)),
    ({"snippet": "a big deal", "text": _TEXT.replace("led by", "with")}, {"confidence": 0.82, "lead_status": "likely_lead", "reextract_reason": "weak lead"}, ("lead_evidence_downgraded", 1)),
    ({"lead_investors": ["Accel", "Sequoia Capital"], "text": _TEXT + " Sequoia Capital joined."}, {"tracked_fund": "Accel, Sequoia Capital"}, None),
    ({"lead_investors": ["Bill Gurley"], "text": _TEXT + " Bill Gurley led it."}, {"tracked_fund": "Benchmark"}, None),
    ({"tracked_fund": None, "lead_investors": [], "participants": ["Benchmark", "Nobody"], "snippet": None, "text": _TEXT + " Benchmark took part."}, {"lead_status": "participant", "tracked_fund": "Benchmark"}, ("investors_removed", 1)),
    ({"startup_name": "Uniswap", "text": _SAYS.format("Uniswap") + " It runs on ethereum."}, {"category": "crypto", "is_ai": False, "is_enterprise": False}, ("crypto_filtered", 1)),
    ({"startup_name": "Datingly", "startup_description": "for people", "text": _SAYS.format("Datingly")}, {"category": "consumer_ai", "is_enterprise": False}, ("consumer_ai_filtered", 1)),
    ({"startup_name": "Robinhood", "text": _SAYS.format("Robinhood") + " It does payments."}, {"category": "fintech", "is_ai": False, "is_enterprise": False}, ("consumer_fintech_filtered", 1)),
    ({"is_ai": False, "is_enterprise": False, "category": "hardware"}, {"is_ai": False, "is_enterprise": False, "category": "other"}, None),
    ({"startup_name": "How to Build a Startup", "text": _SAYS.format("How to Build a Startup")}, {"verdict": "no announcement"}, ("article_title_rejected", 1)),
    ({"text": "Beta raised $5 million in a round led by Accel with Jane Doe. " + "word " * 200 + "Acme is near."}, {"verdict": "no announcement"}, ("background_mention_rejected", 1)),
    ({"amount_usd": 60_000_000}, {"amount_review_reason": "over threshold"}, ("amount_flagged_for_review", 1)),
    ({"amount_usd": 150_000_000, "text": _TEXT + " The $150 billion market is large."}, {"amount_review_reason": "market size"}, ("amount_flagged_for_review", 1)),
    ({"round_date": _D(2027, 1, 1)}, {"round_date": None}, None),
    ({"round_date": _D(2024, 1, 1)}, {"round_date": None}, None),
    ({"round_date": _D(2026, 1, 30), "text": _TEXT + " It was 6 months ago."}, {"round_date": _D(2025, 7, 31)}, ("relative_date_corrected", 1)),
    ({"round_date": _D(2025, 12, 1), "text": _TEXT + " It was 6 months ago."}, {"round_date": _D(2025, 12, 1)}, None),
    ({"evidence": ""}, {"verdict": "no announcement"}, None),
    ({"startup_name": "N/A", "text": _SAYS.format("N/A")}, {"verdict": "invalid name"}, None),
    ({"confidence": 0.55, "founders": []}, {"confidence": 0.55, "band": "below 0.65", "reextract_reason": "low confidence"}, None),
    ({"confidence": float("nan")}, {"confidence": 0.0, "verdict": "low confidence", "band": "below 0.35"}, None),
    ({"source_url": "https://news.google.com/x", "confidence": 0.38, "founders": []}, {"confidence": 0.38, "verdict": "low confidence", "band": "below 0.50", "reextract_reason": "low confidence"}, None),
]


def _literal(x) -> str:
    if x is None:
        return "NULL"
    return f"DATE '{x}'" if isinstance(x, datetime.date) else str(x).lower() if isinstance(x, (bool, int, float)) else "'" + x.replace("'", "''") + "'"


_EXPECTED = "expected(k, " + ", ".join(RESULT) + ") AS (VALUES " + ", ".join("(" + ", ".join([str(k), *(_literal((RESULT | r)[c]) for c in RESULT)]) + ")" for k, (_, r, _) in enumerate(CASES)) + ")"
_COUNTED = "counted(k, counter, n) AS (VALUES " + ", ".join(f"({k}, '{c[0]}', {c[1]})" for k, (*_, c) in enumerate(CASES) if c) + ")"
_COUNTER_NAMES = [*validate.COUNTERS, "investors_removed", "founders_removed"]


def judged_cases(v: Views) -> DataFrame:
    rows = [(k, *(BASE | changes).values()) for k, (changes, *_) in enumerate(CASES)]
    cases = v.spark.createDataFrame(rows, "k int, " + SCHEMA)
    return validate.judge(v.landed_rows.select("id", (F.col("id") % len(CASES)).cast("int").alias("k")).join(F.broadcast(cases), "k"), TODAY)


@query(f"WITH {_EXPECTED} SELECT r.id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' if c == 'confidence' else f'CAST({c} AS DATE) AS {c}' if c == 'round_date' else c for c in RESULT)} FROM landed_rows r JOIN expected ON r.id % {len(CASES)} = k")
def val01_judged_extractions(v: Views) -> DataFrame:
    """All steps over cases that meet every rule."""
    return judged_cases(v).select("id", *[F.round(c, 6).alias(c) if c == "confidence" else c for c in RESULT])


@query(f"WITH {_EXPECTED} SELECT verdict, band, count(*) AS n FROM landed_rows r JOIN expected ON r.id % {len(CASES)} = k GROUP BY 1, 2")
def val02_verdict_counts(v: Views) -> DataFrame:
    """How many extractions each verdict and band has."""
    return judged_cases(v).groupBy("verdict", "band").agg(F.count("*").alias("n"))


@query(f"WITH {_COUNTED} SELECT {', '.join(f'''CAST(coalesce(sum(n) FILTER (WHERE counter = '{c}'), 0) AS BIGINT) AS {c}''' for c in _COUNTER_NAMES)} FROM landed_rows r JOIN counted ON r.id % {len(CASES)} = k")
def agg11_rejections(v: Views) -> DataFrame:
    """The thirteen counters of a run."""
    return validate.counted(judged_cases(v)).select(*_COUNTER_NAMES)


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN 0.8 ELSE 0.5 END AS confidence, id % 4 = 0 OR id % 4 = 1 OR id % 4 = 2 AS from_second FROM landed_rows WHERE id % 5 <> 0 UNION ALL SELECT id, 0.5, false FROM landed_rows WHERE id % 5 = 0""")
def step16_better_reading(v: Views) -> DataFrame:
    """The better of two readings: surer, more founders, or evidence no longer weak."""
    k = F.col("id") % 4
    one = v.landed_rows.select("id", F.lit(0.5).alias("confidence"), F.array(F.lit("A")).alias("founders"), (k == 2).alias("lead_evidence_weak"))
    two = v.landed_rows.where("id % 5 != 0").select("id", F.when(k == 0, 0.8).otherwise(0.5).alias("confidence"), F.when(k == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A"))).alias("founders"), F.lit(False).alias("lead_evidence_weak"))
    return validate.better(one, two, "id").select("id", "confidence", "from_second")
