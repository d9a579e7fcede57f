"""Articles from rows of many sources: each function gives the columns of an article, for ``select``.

Columns: ``url, title, text, published_date, author, tags array<string>, fund_slug, sec_amount_usd, amount_source``.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.text import lowered


def lines(*parts: Column | str) -> Column:
    """Parts as lines; null ones are left out."""
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def given(label: str, value: Column) -> Column:
    """``label`` and a value, or null for an empty one."""
    text = value.cast("string")
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(label), text))


def _or(value: Column, other: Column | str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(F.lit(other) if isinstance(other, str) else other)


def _tags(*tags: Column | str) -> Column:
    return F.array_compact(F.array(*[F.lit(t) if isinstance(t, str) else t for t in tags]))


def article(url: Column, title: Column, text: Column, day: Column, author: Column | str, tags: Column, fund: Column | None = None, usd: Column | None = None, usd_source: Column | None = None) -> list[Column]:
    none = lambda kind: F.lit(None).cast(kind)
    return [
        url.alias("url"), title.alias("title"), text.alias("text"), day.cast("date").alias("published_date"), (F.lit(author) if isinstance(author, str) else author).alias("author"), tags.alias("tags"),
        F.coalesce(fund if fund is not None else none("string"), F.lit("")).alias("fund_slug"), (usd if usd is not None else none("long")).alias("sec_amount_usd"),
        (usd_source if usd_source is not None else none("string")).alias("amount_source"),
    ]


def of_filing() -> list[Column]:
    """Form D: company_name, filing_date, form_type, amount_raised, total_offering, investors, industry, state, is_first_sale, url, fund."""
    c = F.col
    text = lines(
        F.concat(F.lit("SEC Form D Filing: "), c("company_name")), F.concat(F.lit("Filing Date: "), c("filing_date").cast("string")), F.concat(F.lit("Form Type: "), c("form_type")),
        given("Amount Raised: ", c("amount_raised")), given("Total Offering: ", c("total_offering")), given("Related Persons: ", F.array_join("investors", ", ")), given("Industry: ", c("industry")),
        given("State of Incorporation: ", c("state")), F.when(c("is_first_sale"), "Note: This is the FIRST sale under this offering."), F.concat(F.lit("\nSEC Filing URL: "), c("url")),
    )
    usd = F.trim(F.regexp_replace("amount_raised", "[$,]", "")).try_cast("long")
    title = F.concat(F.lit("SEC Form D: "), c("company_name"), F.lit(" - "), _or(c("amount_raised"), "Amount TBD"))
    tags = _tags("sec", "form_d", c("form_type"), F.when(c("state") == "DE", "delaware"))
    return article(c("url"), title, text, c("filing_date"), "SEC EDGAR", tags, c("fund"), usd, F.when(usd != 0, "sec_form_d"))


def story_type(title: Column) -> Column:
    """Launch, show and ask posts by how their titles begin."""
    t = lowered(title)
    return F.when(t.startswith("launch hn"), "launch_hn").when(t.startswith("show hn"), "show_hn").when(t.startswith("ask hn"), "ask_hn").otherwise("story")


def of_story() -> list[Column]:
    """Posts: story_id, title, link, score, comments, author, body, day, fund."""
    c = F.col
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), c("story_id").cast("string"))
    kind = story_type(c("title"))
    text = lines(
        F.concat(F.lit("Hacker News: "), c("title")), F.concat(F.lit("Type: "), kind), F.concat(F.lit("Score: "), c("score").cast("string"), F.lit(" points")), F.concat(F.lit("Comments: "), c("comments").cast("string")),
        F.concat(F.lit("Author: "), c("author")), given("\n", c("body")), given("\nLink: ", c("link")), F.concat(F.lit("HN Discussion: "), page),
    )
    return article(_or(c("link"), page), c("title"), text, c("day"), c("author"), _tags("hackernews", kind), c("fund"))


def of_repository() -> list[Column]:
    """Trending repositories: name, url, description, language, stars_today, total_stars, forks, built_by, readme."""
    c = F.col
    text = lines(
        F.concat(F.lit("GitHub Trending: "), c("name")), F.concat(F.lit("Description: "), c("description")), F.concat(F.lit("Language: "), _or(c("language"), "Unknown")),
        F.concat(F.lit("Stars Today: "), F.format_number("stars_today", 0)), F.concat(F.lit("Total Stars: "), F.format_number("total_stars", 0)), F.concat(F.lit("Forks: "), F.format_number("forks", 0)),
        given("Top Contributors: ", F.array_join("built_by", ", ")), F.concat(F.lit("\nGitHub URL: "), c("url")), given("\n--- README ---\n", F.substring("readme", 1, 2000)),
    )
    title = F.concat(F.lit("GitHub Trending: "), c("name"), F.lit(" (+"), c("stars_today").cast("string"), F.lit(" stars) - "), F.substring("description", 1, 80))
    return article(c("url"), title, text, F.lit(None), F.try_element_at("built_by", F.lit(1)), _tags("github", "trending", _or(F.lower("language"), "unknown")))


def of_batch_company() -> list[Column]:
    """Accelerator companies: name, url, description, batch, industry, location, website."""
    c = F.col
    text = lines(
        F.concat(F.lit("Y Combinator Company: "), c("name")), F.concat(F.lit("Batch: "), c("batch")), F.concat(F.lit("Description: "), c("description")), given("Industry: ", c("industry")),
        given("Location: ", c("location")), given("Website: ", c("website")), F.concat(F.lit("\nYC Profile: "), c("url")), "\nNote: Y Combinator Demo Day company - potential early-stage investment opportunity",
    )
    title = F.concat(F.lit("YC "), c("batch"), F.lit(": "), c("name"), F.lit(" - "), F.substring("description", 1, 100))
    return article(c("url"), title, text, F.lit(None), "Y Combinator", _tags("ycombinator", "demo_day", c("batch"), F.lower(given("", c("industry")))))


def of_job(as_of: datetime.date) -> list[Column]:
    """Job posts: url, title, company_name, description, is_stealth, fund, posted_date."""
    c = F.col
    text = lines(
        F.when(c("is_stealth"), "[STEALTH STARTUP DETECTED]"), "STEALTH SIGNAL: LinkedIn Job Posting", F.concat(F.lit("Company: "), c("company_name")), F.concat(F.lit("Job: "), c("title")), "",
        F.concat(F.lit("Description: "), c("description")), "", F.concat(F.lit("LinkedIn URL: "), c("url")), given("\nMatched Fund: ", c("fund")),
    )
    title = F.concat(F.lit("Stealth Signal: "), c("company_name"), F.lit(" - "), F.substring("title", 1, 50))
    tags = _tags("linkedin_jobs", "stealth_signal", F.when(c("is_stealth"), "stealth"), given("fund:", c("fund")))
    return article(c("url"), title, text, F.coalesce(c("posted_date"), F.lit(as_of)), "LinkedIn Jobs", tags, c("fund"))


def of_entity() -> list[Column]:
    """Registry entities: entity_name, entity_type, status, file_number, formation_date, registered_agent, source_url, has_tech_name, has_startup_agent."""
    c = F.col
    signals = F.concat_ws(", ", F.when(c("has_tech_name"), "Tech company name pattern"), F.when(c("has_startup_agent"), "Startup-friendly registered agent"))
    text = lines(
        "[DELAWARE INCORPORATION DETECTED]", "", F.concat(F.lit("Entity: "), c("entity_name")), F.concat(F.lit("Type: "), c("entity_type")), F.concat(F.lit("Status: "), c("status")), given("File Number: ", c("file_number")),
        given("Formation Date: ", c("formation_date")), given("Registered Agent: ", c("registered_agent")), "", F.concat(F.lit("Signals: "), _or(signals, "None")), "",
        "Note: ~67% of VC-backed startups incorporate in Delaware.", "New tech company formations may indicate upcoming funding.", given("\nSource: ", c("source_url")),
    )
    tags = _tags("delaware", "incorporation", "stealth_signal", F.when(c("has_tech_name"), "tech_name"), F.when(c("has_startup_agent"), "startup_agent"))
    return article(_or(c("source_url"), "https://icis.corp.delaware.gov/"), F.concat(F.lit("Delaware Filing: "), c("entity_name")), text, c("formation_date"), "Delaware Division of Corporations", tags)


def of_trademark() -> list[Column]:
    """Trademarks: mark_text, filing_date, serial_number, nice_class, applicant_name, goods_services, url."""
    c = F.col
    labelled = lambda label, x: F.concat(F.lit(label), x)
    text = lines(
        "\U0001f4cb USPTO TRADEMARK APPLICATION", "", labelled("Mark: ", c("mark_text")), labelled("Filing Date: ", c("filing_date").cast("string")), labelled("Serial Number: ", c("serial_number")),
        labelled("Nice Class: ", c("nice_class")), "", labelled("Applicant: ", _or(c("applicant_name"), "Not disclosed")), "", labelled("Goods/Services: ", c("goods_services")), "",
        "Note: Trademark applications are often filed BEFORE company announcements.", "This could indicate a new startup or product launch.", given("\nUSPTO URL: ", c("url")),
    )
    page = labelled("https://tsdr.uspto.gov/#caseNumber=", c("serial_number"))
    return article(_or(c("url"), page), labelled("USPTO Filing: ", c("mark_text")), text, c("filing_date"), "USPTO", _tags("uspto", "trademark", "stealth_signal", labelled("class_", c("nice_class"))))


def of_tweet() -> list[Column]:
    """Tweets: url, body, username, author, day; long ones are cut in the title."""
    c = F.col
    title = F.concat(F.lit("@"), c("username"), F.lit(": "), F.substring("body", 1, 100), F.when(F.char_length("body") > 100, "...").otherwise(""))
    return article(c("url"), title, c("body"), c("day"), c("author"), _tags("twitter", c("username")))


def of_addition(as_of: datetime.date) -> list[Column]:
    """New companies on a fund's portfolio page: fund_slug, name, url, first_seen."""
    c = F.col
    text = lines(
        "[STEALTH PORTFOLIO ADDITION DETECTED]", "", F.concat(F.lit("Fund: "), c("fund_slug")), F.concat(F.lit("Company: "), c("name")), F.concat(F.lit("First Seen: "), F.coalesce(c("first_seen").cast("string"), F.lit("None"))), "",
        F.concat(F.lit("This company was just added to "), c("fund_slug"), F.lit("'s portfolio page.")), "This often happens BEFORE any public funding announcement.", given("\nPortfolio URL: ", c("url")),
    )
    pages = F.create_map(*[F.lit(x) for kv in fixed.PORTFOLIO_PAGES.items() for x in kv])
    page = F.coalesce(F.try_element_at(pages, c("fund_slug")), F.concat(F.lit("https://"), c("fund_slug"), F.lit(".com/portfolio/")))
    fallback = F.concat(F.regexp_replace(page, "/+$", ""), F.lit("#"), F.replace(F.lower("name"), F.lit(" "), F.lit("-")))
    title = F.concat(F.lit("Stealth Addition: "), c("name"), F.lit(" added to "), c("fund_slug"), F.lit(" portfolio"))
    return article(_or(c("url"), fallback), title, text, F.coalesce(c("first_seen"), F.lit(as_of)), F.concat(c("fund_slug"), F.lit(" Portfolio")), _tags("portfolio_diff", "stealth", "pre_announcement", c("fund_slug")), c("fund_slug"))


def of_news(as_of: datetime.date) -> list[Column]:
    """Search-news items: url, real_url, title, source, fund_name, fund, description, full_text, day; the article itself where it is long enough."""
    c = F.col
    whole = F.concat(F.lit("Headline: "), c("title"), F.lit("\nSource: "), _or(c("source"), "Unknown"), F.lit("\nFund Context: "), c("fund_name"), F.lit("\n\nArticle Content:\n"), c("full_text"))
    brief = lines(F.concat(F.lit("Headline: "), c("title")), given("Source: ", c("source")), F.concat(F.lit("Fund: "), c("fund_name")), given("", c("description")))
    text = F.when(F.char_length("full_text") > 200, whole).otherwise(brief)
    return article(_or(c("real_url"), c("url")), c("title"), text, F.coalesce(c("day"), F.lit(as_of)), c("source"), _tags("google_news", c("fund")), c("fund"))


def with_title(title: Column, text: Column) -> Column:
    """The text that goes to extraction: the title stands before it."""
    t = F.trim(title)
    return F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit("ARTICLE TITLE: "), t, F.lit("\n\n"), text)).otherwise(text)


def ingested_round(label: Column) -> Column:
    """The round that a deal of a structured batch names."""
    rounds = F.create_map(*[F.lit(x) for kv in fixed.INGEST_ROUNDS.items() for x in kv])
    return F.coalesce(F.try_element_at(rounds, F.trim(F.lower(label))), F.lit("unknown"))


def of_structured_deal() -> list[Column]:
    """An extraction from a structured deal: startup_name, description, website, round_type, amount, announced_date, lead_investors, participants, industries."""
    from ledgerloom.functions.classify import ai_of_industries
    from ledgerloom.functions.funds import matched_fund

    c = F.col
    mention = lambda role: lambda x: F.struct(x.alias("name"), F.lit(role).alias("role"), matched_fund(x).isNotNull().alias("is_tracked_fund"))
    leads = F.transform("lead_investors", mention("confirmed_lead"))
    tracked = F.filter(leads, lambda x: x["is_tracked_fund"])
    kind = ai_of_industries(c("industries"), c("description"))
    day = F.coalesce(F.try_to_date("announced_date", "yyyy-MM-dd"), F.try_to_date("announced_date", "MMM d, yyyy"))
    return [
        c("startup_name"), c("description").alias("startup_description"), c("website").alias("company_website"), ingested_round(c("round_type")).alias("round_label"), c("amount"), day.alias("round_date"),
        leads.alias("lead_investors"), F.transform("participants", mention("participant")).alias("participating_investors"), (F.size(tracked) > 0).alias("tracked_fund_is_lead"),
        F.try_element_at(tracked, F.lit(1))["name"].alias("tracked_fund_name"), F.when(F.size(tracked) > 0, "confirmed_lead").alias("tracked_fund_role"), kind["category"].alias("enterprise_category"),
        kind["is_enterprise"].alias("is_enterprise_ai"), kind["is_ai"].alias("is_ai_deal"), F.when(F.size("lead_investors") > 0, F.concat(F.lit("Lead investors: "), F.array_join("lead_investors", ", "))).alias("verification_snippet"),
        F.lit(0.95).alias("confidence_score"), F.lit(True).alias("is_new_announcement"), F.lit("From Crunchbase Pro funding database").alias("announcement_evidence"),
    ]


def marked_text(fund: Column, title: Column, text: Column) -> Column:
    """Texts of funds' own pages, with a first line for private equity deals and for rounds that the fund leads."""
    both = F.concat_ws(" ", lowered(title), lowered(text))
    forge = (fund == "bessemer") & both.rlike("bvp forge|bessemer forge")
    leads = (fund == "usv") & text.rlike("(?i)" + fixed.PAGE_LEADS)
    return F.when(forge, F.concat(F.lit("[BVP FORGE - PE/BUYOUT]\n"), text)).when(leads, F.concat(F.lit("[USV IS LEADING]\n"), text)).otherwise(text)


def fund_query(slug: Column, names: dict[str, str], lead: bool = True) -> Column:
    """The search for a fund's deals: its first name, words of leading or backing, words of funding, and what to leave out."""
    verbs = '"led by" OR leads OR led' if lead else "backs OR invests OR invested"
    out = F
    for k, name in names.items():
        out = out.when(slug == k, F.lit(" ".join([f'"{name}" AND ({verbs}) AND (funding OR raises OR "Series A" OR "Series B")', *fixed.QUERY_EXCLUDES.get(k, [])])))
    return out.otherwise("")


def enterprise_query(category: Column) -> Column:
    """The search for enterprise deals of a category."""
    words = F.create_map(*[F.lit(x) for kv in fixed.ENTERPRISE_QUERIES.items() for x in kv])
    return F.concat(F.lit("("), F.coalesce(F.try_element_at(words, category), F.lit('"enterprise AI" OR "AI startup" OR "AI infrastructure"')), F.lit(") AND (funding OR raises) AND (led OR leads)"))
