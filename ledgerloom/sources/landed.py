"""Rows of landed API answers and feeds: posts, companies, filings, searches, tweets."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import classify, dates, fixed, pages
from ledgerloom.functions.funds import matched_fund
from ledgerloom.functions.names import stripped
from ledgerloom.sources import markup


def first_of(rows: DataFrame, key: Column | str, *order: str) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_first", n).where("_first = 1").drop("_first")


def articles(raw: DataFrame) -> DataFrame:
    """A fund's pages (``fund, title, html, url``) that none of its negative keywords rules out, as articles of their text."""
    from ledgerloom.sources.exports import plain_text

    kept = raw.where(~pages.negative(F.col("fund"), F.col("title"), F.col("html")))
    return kept.withColumn("text", plain_text(F.col("html"))).drop("html")


def fund_lists(raw: DataFrame) -> DataFrame:
    """Items of funds' list pages (``fund, html``), each page by its fund's selectors, in one pass; funds that never list anything give none."""
    items = markup.listed(F.col("html"), F.col("fund"), fixed.FUND_PAGES, fixed.OWN_DOMAIN_PAGES)
    out = raw.where(F.col("fund").isin(list(fixed.FUND_PAGES))).select("fund", F.explode(items).alias("i")).select("fund", "i.*")
    day = F.coalesce(dates.absolute(F.col("day")), F.try_to_date("day", "MMMM d, yyyy"))
    return out.withColumn("published_date", day).drop("day")


def read_atom(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Entries of Atom feeds; those without title or link go."""
    schema = "title string, link struct<_href:string,_VALUE:string>, updated string, published string, summary string"
    e = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    plain = F.substring(stripped(F.regexp_replace(F.coalesce("summary", F.lit("")), "<[^>]*>", "")), 1, 1000)
    url = F.coalesce("link._href", "link._VALUE")
    when = F.coalesce(F.try_to_date(F.substring("published", 1, 10), "yyyy-MM-dd"), F.try_to_date(F.substring("updated", 1, 10), "yyyy-MM-dd"))
    return e.where(F.col("title").isNotNull() & url.isNotNull()).select(F.lit(source).alias("source"), "title", url.alias("url"), when.alias("published_date"), plain.alias("text"))


STORIES = "hits array<struct<objectID:string,title:string,url:string,points:bigint,num_comments:bigint,author:string,story_text:string,created_at_i:bigint>>"


def stories(answers: DataFrame, now: datetime.datetime, hours: int = 168) -> DataFrame:
    """Posts of search answers (``rank, answer``) from after a cutoff, the first of each id in order of rank."""
    cutoff = int((now - datetime.timedelta(hours=hours)).replace(tzinfo=datetime.timezone.utc).timestamp())
    hits = answers.select("rank", F.posexplode(F.from_json("answer", STORIES)["hits"]).alias("pos", "h")).select("rank", "pos", "h.*")
    fresh = hits.where((F.col("created_at_i") > cutoff) & F.col("title").isNotNull())
    return first_of(fresh, "objectID", "rank", "pos").select(F.col("objectID").alias("story_id"), "title", F.col("url").alias("link"), F.coalesce("points", F.lit(0)).alias("score"), F.coalesce("num_comments", F.lit(0)).alias("comments"), "author", F.col("story_text").alias("body"), F.to_date(F.timestamp_seconds("created_at_i")).alias("day"))


BATCHES = "hits array<struct<name:string,slug:string,one_liner:string,batch:string,industries:array<string>,all_locations:string,website:string,status:string>>"


def batch_companies(answers: DataFrame, most_pages: int = 10) -> DataFrame:
    """Companies of index pages (``batch_rank, page, answer``), up to ten pages a batch; those without name or address go, the first batch wins a name."""
    hits = answers.where(F.col("page") < most_pages).select("batch_rank", "page", F.posexplode(F.from_json("answer", BATCHES)["hits"]).alias("pos", "h")).select("batch_rank", "page", "pos", "h.*")
    named = hits.where((F.trim(F.coalesce("name", F.lit(""))) != "") & (F.coalesce("slug", F.lit("")) != "")).withColumn("name", F.trim("name"))
    industry = F.array_join(F.filter(F.coalesce("industries", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    return first_of(named, "name", "batch_rank", "page", "pos").select("name", F.concat(F.lit("https://www.ycombinator.com/companies/"), "slug").alias("url"), F.coalesce("one_liner", F.lit("")).alias("description"), "batch", industry.alias("industry"), F.col("all_locations").alias("location"), "website")


def filings_of_feed(entries: DataFrame, cutoff: datetime.date, most: int = 100) -> DataFrame:
    """Form D filings of a feed's first entries (``seq, title, updated, published, link``): those that parse, none from before the cutoff."""
    t = r"^(D(?:/A)?)\s*-\s*(.+?)\s*\((\d+)\)"
    part = lambda g: F.regexp_extract("title", t, g)
    accession = F.regexp_extract("link", r"/(\d{10}-\d{2}-\d{6})", 1)
    year = F.nullif(F.regexp_extract("link", r"/\d{10}-(\d{2})-\d{6}/", 1), F.lit("")).cast("int")
    of_link = F.make_date(F.when(year <= 50, 2000 + year).otherwise(1900 + year), F.lit(1), F.lit(1))
    iso = lambda c: F.to_date(F.try_to_timestamp(F.regexp_extract(c, r"^(\d{4}-\d{2}-\d{2})(?:[T ]|$)", 1)))
    first = entries.orderBy("seq").limit(most)  # the feed's own limit, before the cutoff
    rows = first.select("seq", part(1).alias("form_type"), F.trim(part(2)).alias("company_name"), part(3).alias("cik"), F.coalesce(iso("updated"), iso("published"), of_link).alias("filing_date"), F.col("link").alias("url"), accession.alias("accession"))
    return rows.where((F.col("cik") != "") & (F.col("filing_date") >= F.lit(cutoff)))


_FORM = (
    "primaryIssuer struct<jurisdictionOfInc:string,issuerStateOrCountry:string>, relatedPersonsList struct<relatedPersonInfo:array<struct<relatedPersonName:struct<firstName:string,lastName:string>>>>, "
    "offeringData struct<industryGroup:struct<industryGroupType:string>,typeOfFiling:struct<newOrAmendment:struct<isAmendment:string>>,offeringSalesAmounts:struct<totalOfferingAmount:string,totalAmountSold:string>>, _corrupt_record string"
)


def filing_details(filings: DataFrame) -> DataFrame:
    """Filings (``form_type, xml``) with what their document says; without a document, or with a broken one, they go."""
    x = filings.where("xml IS NOT NULL").withColumn("x", F.from_xml("xml", _FORM, {"mode": "PERMISSIVE"})).where("x IS NOT NULL AND x._corrupt_record IS NULL")
    money = lambda c: F.concat(F.lit("$"), F.format_number(F.trim(c).try_cast("double").cast("long"), 0))
    sums, name = "x.offeringData.offeringSalesAmounts.", lambda p: p["relatedPersonName"]
    person = lambda p: F.trim(F.concat(F.coalesce(name(p)["firstName"], F.lit("")), F.lit(" "), F.coalesce(name(p)["lastName"], F.lit(""))))
    people = F.array_distinct(F.filter(F.transform("x.relatedPersonsList.relatedPersonInfo", person), lambda n: n != ""))
    amended = F.col("x.offeringData.typeOfFiling.newOrAmendment.isAmendment")
    state = F.upper(F.trim(F.coalesce("x.primaryIssuer.jurisdictionOfInc", "x.primaryIssuer.issuerStateOrCountry")))
    codes = F.create_map(*[F.lit(v) for kv in fixed.STATES.items() for v in kv])
    return x.withColumns({
        "total_offering": money(F.col(sums + "totalOfferingAmount")), "amount_raised": money(F.col(sums + "totalAmountSold")), "investors": F.coalesce(people, F.array().cast("array<string>")),
        "is_first_sale": F.when(amended.isNotNull(), F.lower(amended) != "true").otherwise(F.col("form_type") == "D"), "industry": F.col("x.offeringData.industryGroup.industryGroupType"),
        "state": F.when(F.length(state) == 2, state).otherwise(F.try_element_at(codes, state)),
    }).drop("x", "xml")


def selected_filings(filings: DataFrame) -> DataFrame:
    """Filings (``seq`` and details) for articles: the first of each filer, no funds, matched with a tracked fund or likely backed; matched ones come first."""
    first = first_of(filings, "cik", "seq").where(~classify.obvious_fund(F.col("company_name")))
    fund = matched_fund(F.concat_ws(" ", "company_name", F.array_join("investors", " ")))
    out = first.withColumn("fund", fund).withColumn("kind", F.when(F.col("fund").isNotNull(), "fund_matched").when(classify.likely_backed(F.col("industry"), F.col("amount_raised"), F.col("total_offering"), F.col("is_first_sale")), "likely_vc"))
    return out.where("kind IS NOT NULL").orderBy("kind", "seq")


SEARCHES = "results array<struct<url:string,title:string,description:string,age:string,page_age:string>>"


def search_results(answers: DataFrame, as_of: datetime.date, most: int = 20) -> DataFrame:
    """Results of landed searches (``search_id, answer``), at most so many of each, with dates from their ages."""
    hits = answers.select("search_id", F.posexplode(F.slice(F.from_json("answer", SEARCHES)["results"], 1, most)).alias("rank", "r")).select("search_id", "rank", "r.url", "r.title", "r.description", "r.age")
    return hits.where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")).withColumn("day", dates.search_age(F.col("age"), as_of))


def merged_searches(results: DataFrame) -> DataFrame:
    """The first result of each address by the rank of its kind of search, with that search's fund, and its tags as one sorted list."""
    order = ("fund", "enterprise", "stealth", "regional", "early", "partner")
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    first = results.groupBy("url").agg(F.min_by(F.struct("fund", "title"), F.struct(rank, F.col("search_id"), F.col("rank"))).alias("f"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("tags"))
    return first.select("url", "f.fund", "f.title", "tags")


def news_items(items: DataFrame, cutoff: datetime.date) -> DataFrame:
    """Items of search news (``seq, url, headline, day``): the first of each address and of each title, none from before the cutoff; the headline's end is its source."""
    title, source = F.regexp_extract("headline", r"^(.*) - (.*?)$", 1), F.regexp_extract("headline", r"^(.*) - (.*?)$", 2)
    split = items.withColumns({"title": F.when(F.col("headline").contains(" - "), title).otherwise(F.col("headline")), "source": F.when(F.col("headline").contains(" - "), source)})
    by_url = first_of(split.where(F.col("day").isNull() | (F.col("day") >= F.lit(cutoff))), "url", "seq")
    return first_of(by_url.withColumn("_low", F.lower("title")), "_low", "seq").drop("_low")


def tweets(answers: DataFrame, now: datetime.datetime, hours: int) -> DataFrame:
    """Tweets of timelines and searches (``rank, answer``), about funding, from after a cutoff, the first of each id."""
    schema = "data array<struct<id:string,text:string,author:string,created_at:string>>"
    rows = answers.select("rank", F.explode(F.from_json("answer", schema)["data"]).alias("t")).select("rank", "t.*").withColumn("created_at", F.try_to_timestamp("created_at"))
    fresh = rows.where((F.col("created_at") >= F.lit(now - datetime.timedelta(hours=hours))) & pages.funding_post(F.col("text")))
    return first_of(fresh, "id", "rank")
