"""Readers of landed files: CSV exports, feeds, HTML pages, position snapshots."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.names import stripped


def _first(df: DataFrame, *headers: str) -> Column:
    """The first of several headers that has a value."""
    known = [F.when(stripped(F.col(f"`{h}`")) != "", stripped(F.col(f"`{h}`"))) for h in headers if h in df.columns]
    return F.coalesce(*known, F.lit(None).cast("string"))


def _listed(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), stripped), lambda x: x != "")


def export_round(kind: Column) -> Column:
    """The round that an export's funding type stands for."""
    low = stripped(F.lower(F.coalesce(kind, F.lit(""))))
    low = F.when(low.contains(" - "), F.trim(F.substring_index(low, " - ", 1))).otherwise(low)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.EXPORT_ROUNDS.items() for x in kv]), low), F.lit("unknown"))


def export_date(text: Column) -> Column:
    formats = ("MMM d, yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy")
    return F.coalesce(*[F.try_to_date(stripped(text), f) for f in formats])


def export_amount(text: Column) -> Column:
    """Plain digits as $1.2B, $30M or $500,000; anything else as it is, a dash as none."""
    n = F.when(text.rlike(r"^\d+$"), text.try_cast("long"))
    pretty = (
        F.when(n >= 1_000_000_000, F.concat(F.lit("$"), F.format_string("%.1f", n / 1_000_000_000), F.lit("B")))
        .when(n >= 1_000_000, F.concat(F.lit("$"), F.bround(n / 1_000_000, 0).cast("long").cast("string"), F.lit("M")))
        .when(n.isNotNull(), F.concat(F.lit("$"), F.format_number(n, 0)))
    )
    return F.when(text != "-", F.coalesce(pretty, text))


def deals_of_export(rows: DataFrame) -> DataFrame:
    """Deals from an export's rows (all columns strings), whichever of its known headers they have."""
    leads, everyone = _listed(_first(rows, "Lead Investors")), _listed(_first(rows, "Investor Names"))
    out = rows.select(
        _first(rows, "Organization Name", "Company Name", "Funded Organization Name").alias("startup_name"), export_round(_first(rows, "Funding Type", "Round")).alias("round_type"),
        export_amount(_first(rows, "Money Raised (in USD)", "Money Raised", "Amount")).alias("amount"), export_date(_first(rows, "Announced Date", "Date")).alias("announced_date"),
        leads.alias("lead_investors"), F.filter(everyone, lambda x: ~F.array_contains(leads, x)).alias("participants"), _listed(_first(rows, "Organization Industries")).alias("industries"),
        _first(rows, "Organization Website").alias("website"),
    )
    return out.where("startup_name IS NOT NULL")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return deals_of_export(spark.read.option("header", True).option("multiLine", True).csv(path))


def read_feed(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Items of RSS files: title, link, date and a summary of 1000 characters without mark-up; items without title or link go."""
    schema = "title string, link string, pubDate string, description string"
    items = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    plain = F.substring(stripped(F.regexp_replace(F.coalesce("description", F.lit("")), "<[^>]*>", "")), 1, 1000)
    when = F.to_date(F.try_to_timestamp(F.regexp_extract("pubDate", r"(\d{1,2} \w{3} \d{4})", 1), F.lit("d MMM yyyy")))
    return items.where("title IS NOT NULL AND link IS NOT NULL").select(F.lit(source).alias("source"), "title", F.col("link").alias("url"), when.alias("published_date"), plain.alias("text"))


class _Text(HTMLParser):
    """Text outside scripts, styles, navigation, headers and footers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "nav", "header", "footer")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "nav", "header", "footer") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def page_texts(pages: pa.Array, step: int = 64) -> pa.Array:
    """Texts of pages, a few at a time as Python strings, so that a worker never holds a batch in three forms."""
    out = [pa.array([], pa.string())]
    for first in range(0, len(pages), step):
        texts = []
        for page in pages.slice(first, step).to_pylist():
            p = _Text()
            p.feed(page or "")
            p.close()
            texts.append("\n".join(p.parts))
        out.append(pa.array(texts, pa.string()))
    return pa.concat_arrays(out)


def plain_text(html: Column) -> Column:
    """The text of an HTML page, one line for each run of it."""

    @F.arrow_udf("string")
    def parse(pages: pa.Array) -> pa.Array:
        return page_texts(pages)

    return parse(html)


def states_of_snapshot(raw: DataFrame) -> DataFrame:
    """Aircraft from ``state array<string>`` (icao, callsign, country, time, contact, lon, lat, altitude, on ground, speed, heading); none without a place."""
    at = lambda k: F.try_element_at("state", F.lit(k + 1))
    rows = raw.select(
        at(0).alias("icao"), F.trim(at(1)).alias("callsign"), at(5).try_cast("double").alias("lon"), at(6).try_cast("double").alias("lat"), at(7).try_cast("double").alias("altitude"),
        at(8).try_cast("boolean").alias("on_ground"), at(9).try_cast("double").alias("speed"), at(10).try_cast("double").alias("heading"),
    )
    return rows.where("lat IS NOT NULL AND lon IS NOT NULL")


def predicted(rows: DataFrame, seconds: Column) -> DataFrame:
    """Positions so many seconds on, up to 15, for aircraft that move: along the heading on a flat earth."""
    t = F.least(seconds, F.lit(15.0))
    metre = 1 / F.lit(111_320.0)
    north = F.col("speed") * t * F.cos(F.radians("heading")) * metre
    east = F.col("speed") * t * F.sin(F.radians("heading")) * metre / F.cos(F.radians("lat"))
    moves = ~F.coalesce("on_ground", F.lit(False)) & (F.col("speed") >= 10) & F.col("heading").isNotNull()
    return rows.withColumns({"lat": F.when(moves, F.col("lat") + north).otherwise(F.col("lat")), "lon": F.when(moves, F.col("lon") + east).otherwise(F.col("lon"))})
