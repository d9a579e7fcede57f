"""The validation of extracted deals, step by step; the order of the steps is part of the result.

Input columns: ``text, external, startup_name, startup_description, round_label, amount_usd, category, is_ai, is_enterprise,
announcement, confidence, snippet, lead_investors array<string>, participants array<string>, founders array<string>,
tracked_fund`` (of which the extractor says that it leads), and where they are known ``source_name, source_url, evidence,
round_date, published_date, website, linkedin_url``.  Each step adds to or changes columns; ``confidence`` falls by each
penalty, never under 0.  ``judge`` gives the steps the column ``_low``, the text in lower case: texts are long, and nearly all steps
read it, some for each name or word.
"""

from __future__ import annotations

import datetime
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, classify, dates, fixed, funds, names, pages, text, urls
from ledgerloom.operators.scans import band

#: Columns that need not be there, with their types and what stands for them.
OPTIONAL = {
    "source_name": ("string", None), "source_url": ("string", None), "evidence": ("string", "given"), "round_date": ("date", None), "published_date": ("date", None), "website": ("string", None),
    "linkedin_url": ("string", None),
}


def with_defaults(deals: DataFrame) -> DataFrame:
    return deals.withColumns({c: F.lit(value).cast(kind) for c, (kind, value) in OPTIONAL.items() if c not in deals.columns})


def from_outside(deals: DataFrame) -> DataFrame:
    """Step 0a: articles of funds and sources that say little count as external."""
    name, url = F.coalesce("source_name", F.lit("")), F.coalesce("source_url", F.lit(""))
    return deals.withColumn("external", F.col("external") | name.isin(*fixed.OUTSIDE_FUNDS, *fixed.OUTSIDE_SOURCES) | url.contains("news.google") | F.lower(url).contains("brave"))


def stubs(deals: DataFrame) -> DataFrame:
    """Step 0c: articles without words of funding, and those of crypto sites, become empty deals of low confidence."""
    stub = F.when(~text.likely_funding_content(F.col("text"), F.col("_low")), "no funding words").when(classify.crypto_site(F.col("source_url")), "crypto site")
    out = deals.withColumn("stub", stub)
    is_stub = F.col("stub").isNotNull()
    none = F.array().cast("array<string>")
    blank = {
        "startup_name": F.lit("Unknown"), "startup_description": F.lit(None), "round_label": F.lit("unknown"), "amount_usd": F.lit(None), "category": F.lit("not_ai"), "is_ai": F.lit(False), "is_enterprise": F.lit(False),
        "announcement": F.lit(False), "confidence": F.when(F.col("stub") == "crypto site", 0.15).otherwise(0.05), "snippet": F.lit(None), "lead_investors": none, "participants": none, "founders": none, "tracked_fund": F.lit(None),
        "round_date": F.lit(None), "website": F.lit(None), "linkedin_url": F.lit(None),
    }
    return out.withColumns({c: F.when(is_stub, x).otherwise(F.col(c)) for c, x in blank.items()})


def valid_fields(deals: DataFrame, as_of: datetime.date | None) -> DataFrame:
    """Step 0d: dates of the last year alone, websites and company pages that are such, announcements with evidence."""
    out = deals
    if as_of is not None:
        out = out.withColumn("round_date", F.when(F.col("round_date").between(F.date_sub(F.lit(as_of), 365), F.lit(as_of)), F.col("round_date")))
    page = F.lower("linkedin_url").contains("linkedin.com/company/")
    return out.withColumns({
        "website": F.when(urls.is_website(F.col("website")), F.col("website")), "linkedin_url": F.when(page, F.col("linkedin_url")),
        "announcement": F.col("announcement") & (F.coalesce("evidence", F.lit("")) != ""),
    })


_SUFFIX_WORDS = sorted({s.strip().lstrip(",").strip() for s in fixed.NAME_SUFFIXES})


def company_in_text(name: Column, t: Column) -> Column:
    """Step 1: whether a lower-case text speaks of a company: its whole name, or enough of the words that aren't suffixes or common."""
    low = names.stripped(F.lower(name))
    words = F.filter(F.split(low, r"(?U)\s+"), lambda w: w != "")
    first = F.try_element_at(words, F.lit(1))
    core = F.filter(words, lambda w: ~w.isin(_SUFFIX_WORDS) & (F.length(w) >= 3))
    core = F.when(F.size(core) > 0, core).when(F.length(first) >= 4, F.array(first)).otherwise(core)
    own = F.filter(core, lambda w: ~w.isin(fixed.COMMON_WORDS))
    alone = lambda w: t.contains(w) & F.regexp_like(t, F.concat(F.lit(r"(?<![a-z0-9])\Q"), w, F.lit(r"\E(?![a-z0-9])")))
    head = F.try_element_at(own, F.lit(1))
    common = t.contains(F.array_join(F.slice(core, 1, 2), " ")) | F.exists(core, alone)
    several = (F.size(F.filter(own, lambda w: (F.length(w) >= 4) & t.contains(w))) >= 2) | ((F.length(head) >= 5) & t.contains(head))
    single = F.when(F.length(head) >= 6, t.contains(head)).when(F.length(head) >= 4, alone(head)).otherwise(False)
    found = F.when(t.contains(low) | (F.size(core) == 0), True).when(F.size(own) == 0, common).when(F.size(own) >= 2, several).otherwise(single)
    return F.coalesce(F.when((F.coalesce(name, F.lit("")) == "") | (F.coalesce(t, F.lit("")) == ""), True).otherwise(found), F.lit(False))


def check_company(deals: DataFrame) -> DataFrame:
    """Steps 1 and 2: companies that the text doesn't name, and funds taken for companies, announce nothing."""
    named = company_in_text(F.col("startup_name"), F.col("_low"))
    fund = classify.fund_structure(F.col("startup_name"), F.col("text"), F.coalesce("amount_usd", F.lit(0)), F.col("_low"))
    out = deals.withColumns({"company_rejected": ~named, "fund_reason": fund})
    return out.withColumn("announcement", F.col("announcement") & named & F.col("fund_reason").isNull())


def _lowered(score: Column, penalty: Column) -> Column:
    return F.greatest(F.lit(0.0), score - penalty)


def clamp_confidence(deals: DataFrame) -> DataFrame:
    """Not-a-number and infinite scores are 0, others lie in 0 to 1."""
    c = F.col("confidence")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return deals.withColumn("confidence", F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))))


def known_rounds(deals: DataFrame) -> DataFrame:
    """Step 3: labels that no round has are unknown."""
    out = deals.withColumn("round_corrected", ~F.coalesce(F.col("round_label").isin(fixed.ROUNDS), F.lit(False)))
    return out.withColumn("round_label", F.when(F.col("round_label").isin(fixed.ROUNDS), F.col("round_label")).otherwise("unknown"))


def ground_investors(deals: DataFrame) -> DataFrame:
    """Investors that the text doesn't name go; each lead that goes costs 0.05, at most 0.15; without leads no tracked fund."""
    low = F.col("_low")
    leads = F.filter("lead_investors", lambda x: funds.named_in(x, low))
    gone = F.size("lead_investors") - F.size(leads)
    out = deals.withColumn("lead_penalty", F.least(F.lit(0.15), gone * 0.05)).withColumn("_had", F.size("lead_investors"))
    others = F.filter("participants", lambda x: funds.named_in(x, low))
    out = out.withColumn("investors_removed", gone + F.size("participants") - F.size(others)).withColumn("lead_investors", leads).withColumn("participants", others)
    out = out.withColumn("tracked_fund", F.when((F.col("_had") > 0) & (F.size("lead_investors") == 0), None).otherwise(F.col("tracked_fund"))).drop("_had")
    return out.withColumn("confidence", _lowered(F.col("confidence"), F.col("lead_penalty")))


def ground_founders(deals: DataFrame) -> DataFrame:
    """Founders of whose name not enough parts occur in the text go; each costs 0.03, at most 0.10."""
    low = F.col("_low")

    def stands(founder: Column) -> Column:
        parts = F.filter(F.split(F.lower(founder), r"\s+"), lambda p: F.length(p) >= 3)
        return F.size(F.filter(parts, lambda p: low.contains(p))) >= F.least(F.lit(2), F.size(parts))

    kept = F.filter("founders", stands)
    out = deals.withColumn("founders_removed", F.size("founders") - F.size(kept)).withColumn("founder_penalty", F.least(F.lit(0.10), F.col("founders_removed") * 0.03)).withColumn("founders", kept)
    return out.withColumn("confidence", _lowered(F.col("confidence"), F.col("founder_penalty")))


def check_lead_evidence(deals: DataFrame) -> DataFrame:
    """Step 7: a tracked lead without a snippet, or without language that says so, is weak and costs 0.08; leads that are tracked funds, with
    such language, are the deal's funds; else the first tracked fund among all investors took part.
    """
    said = funds.lead_language(F.col("snippet")) | funds.lead_language(F.col("text"), F.col("_low"))
    claimed, snippet = F.col("tracked_fund").isNotNull(), F.coalesce("snippet", F.lit("")) != ""
    label = F.create_map(*[F.lit(x) for kv in fixed.FUND_LABELS.items() for x in kv])
    tracked = lambda c: F.array_compact(F.transform(c, lambda x: label[funds.matched_fund(x, invests=F.col("_invests"))]))
    some = (F.size("lead_investors") > 0) | (F.size("participants") > 0)
    out = deals.withColumn("_invests", F.when(some, funds.speaks_of_investment(F.coalesce("_low", F.lit("")))))
    out = out.withColumns({"said": said, "lead_funds": tracked("lead_investors"), "other_funds": tracked("participants")})
    weak = claimed & (~snippet | ~F.col("said"))
    out = out.withColumns({"lead_evidence_weak": weak, "lead_evidence": F.when(claimed, F.when(F.col("said"), 1.0).when(snippet, 0.5).otherwise(0.2))})
    led = F.col("said") & (F.size("lead_funds") > 0)
    first = F.coalesce(F.try_element_at("lead_funds", F.lit(1)), F.try_element_at("other_funds", F.lit(1)))
    status = F.when(led, "confirmed_lead").when(F.col("lead_evidence_weak"), "likely_lead").when(claimed, "confirmed_lead").when(first.isNotNull(), "participant").otherwise("none")
    fund = F.when(led, F.array_join("lead_funds", ", ")).otherwise(F.coalesce("tracked_fund", first))
    out = out.withColumns({"lead_status": status, "tracked_fund": fund, "tracked_fund_is_lead": led | claimed})
    out = out.withColumn("confidence", F.when(F.col("lead_evidence_weak"), _lowered(F.col("confidence"), F.lit(0.08))).otherwise(F.col("confidence")))
    return out.drop("said", "other_funds", "_invests")


def correct_classes(deals: DataFrame) -> DataFrame:
    """Crypto, then consumer AI, then consumer fintech, then categories without a word of theirs in the text."""
    name, description, text, low = F.col("startup_name"), F.col("startup_description"), F.col("text"), F.col("_low")
    crypto = F.col("is_ai") & classify.crypto(name, description, text, F.col("tracked_fund"), F.col("lead_investors"), low).isNotNull()
    out = deals.withColumn("_c", crypto).withColumns({"category": F.when(crypto, "crypto").otherwise(F.col("category"))})
    out = out.withColumns({c: F.col(c) & ~F.col("_c") for c in ("is_ai", "is_enterprise")})
    consumer = F.col("is_enterprise") & classify.consumer_ai(name, description, text, F.col("category"), low).isNotNull()
    out = out.withColumn("_crypto", F.col("_c")).withColumn("_c", consumer).withColumn("consumer_ai", F.col("_c"))
    out = out.withColumn("category", F.when(F.col("_c") & ~F.col("category").isin(fixed.CONSUMER_CATEGORIES), "consumer_ai").otherwise(F.col("category")))
    out = out.withColumn("is_enterprise", F.col("is_enterprise") & ~F.col("_c"))
    fintech = (F.col("is_ai") | F.col("is_enterprise")) & classify.consumer_fintech(name, description, text, low).isNotNull()
    out = out.withColumn("_c", fintech).withColumn("category", F.when(F.col("_c"), "fintech").otherwise(F.col("category")))
    out = out.withColumn("reclassified", F.when(F.col("_crypto"), "crypto").when(F.col("_c"), "fintech"))
    out = out.withColumns({c: F.col(c) & ~F.col("_c") for c in ("is_ai", "is_enterprise")}).drop("_c", "_crypto")
    plain = ~F.col("is_ai") & ~F.col("is_enterprise")
    return out.withColumn("category", F.when(plain, classify.grounded_category(F.col("category"), text, description, low)).otherwise(F.col("category")))


def check_announcement(deals: DataFrame) -> DataFrame:
    """Step 12: titles taken for names, and companies that the text mentions in passing, announce nothing."""
    out = deals.withColumn("title_rejected", names.looks_like_title(F.col("startup_name")))
    out = out.withColumn("announcement", F.col("announcement") & ~F.col("title_rejected"))
    passing = F.col("announcement") & classify.background_mention(F.col("startup_name"), F.col("text"), F.col("external"), F.col("_low"))
    out = out.withColumn("background_rejected", passing)
    return out.withColumn("announcement", F.col("announcement") & ~F.col("background_rejected"))


def review_amount(deals: DataFrame) -> DataFrame:
    """Step 13: amounts over what their round usually brings."""
    reason = amounts.review_reason(F.col("amount_usd"), F.col("round_label"), F.col("text"), F.col("_low"))
    return deals.withColumn("amount_review_reason", reason).withColumn("amount_review", F.col("amount_review_reason").isNotNull())


def correct_date(deals: DataFrame, as_of: datetime.date | None) -> DataFrame:
    """Step 14: dates near today that the text contradicts."""
    if as_of is None:
        return deals.withColumn("date_corrected", F.lit(False))
    out = deals.withColumn("_day", dates.corrected(F.col("round_date"), F.col("text"), F.col("published_date"), as_of, F.col("_low")))
    return out.withColumn("date_corrected", F.coalesce(F.col("_day") != F.col("round_date"), F.lit(False))).withColumn("round_date", F.col("_day")).drop("_day")


def try_again(deals: DataFrame) -> DataFrame:
    """Step 15: why a better extractor should read an announcement again: middling confidence with weak evidence or without founders, or a weak lead."""
    c, weak = F.col("confidence"), F.col("lead_evidence_weak")
    low = F.when(F.col("external"), fixed.AGAIN_FROM_OUTSIDE).otherwise(fixed.AGAIN_FROM)
    middling = c.between(low, F.lit(fixed.AGAIN_TO)) & (weak | (F.size("founders") == 0))
    reason = F.when(F.col("announcement"), F.when(middling, "low confidence").when((c > fixed.AGAIN_TO) & weak & F.col("tracked_fund_is_lead"), "weak lead"))
    return deals.withColumn("reextract_reason", reason)


def better(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Step 16: the second reading of a deal where it is surer, has more founders or evidence that isn't weak; the first one otherwise."""
    a, b = first.alias("a"), second.alias("b")
    wins = (F.col("b.confidence") > F.col("a.confidence")) | (F.size("b.founders") > F.size("a.founders")) | (F.col("a.lead_evidence_weak") & ~F.col("b.lead_evidence_weak"))
    picked = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left").withColumn("_wins", F.coalesce(wins, F.lit(False)))
    return picked.select(*[F.when(F.col("_wins"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in first.columns], F.col("_wins").alias("from_second"))


def judge(deals: DataFrame, as_of: datetime.date | None = None, funding_only: bool = True) -> DataFrame:
    """All steps in their order, the band and the verdict of every deal; without ``as_of`` dates aren't checked."""
    out = from_outside(with_defaults(deals)).withColumn("_low", F.lower("text"))
    out = stubs(out) if funding_only else out.withColumn("stub", F.lit(None).cast("string"))
    out = valid_fields(out, as_of)
    for step in (check_company, known_rounds, clamp_confidence, ground_investors, ground_founders, check_lead_evidence, correct_classes, check_announcement, review_amount):
        out = step(out)
    out = try_again(correct_date(out, as_of))
    c = F.col("confidence")
    bar = F.when(F.col("external"), 0.40).otherwise(0.50)
    verdict = F.when(~F.col("announcement"), "no announcement").when(pages.no_company_name(F.col("startup_name")), "invalid name").when(c < bar, "low confidence").otherwise("accepted")
    return out.withColumn("band", band(c)).withColumn("verdict", verdict).drop("_low")


#: What each counter counts, of the columns that ``judge`` leaves.
COUNTERS = {
    "crypto_filtered": "reclassified = 'crypto'", "consumer_ai_filtered": "consumer_ai", "consumer_fintech_filtered": "reclassified = 'fintech'", "company_name_rejected": "company_rejected",
    "background_mention_rejected": "background_rejected", "article_title_rejected": "title_rejected", "lead_evidence_downgraded": "lead_evidence_weak", "amount_flagged_for_review": "amount_review",
    "round_type_corrected": "round_corrected", "relative_date_corrected": "date_corrected", "fund_raise_rejected": "fund_reason IS NOT NULL",
}


def counted(judged: DataFrame) -> DataFrame:
    """The counters of a run: how many deals each rule touched, and how many investors and founders went; stubs touch none."""
    removed = [F.coalesce(F.sum("investors_removed"), F.lit(0)).alias("investors_removed"), F.coalesce(F.sum("founders_removed"), F.lit(0)).alias("founders_removed")]
    return judged.where("stub IS NULL").agg(*[F.count_if(F.expr(rule)).alias(name) for name, rule in COUNTERS.items()], *removed)
