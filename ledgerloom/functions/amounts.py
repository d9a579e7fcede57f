"""Amounts of money in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import fixed
from ledgerloom.functions.apart import apart
from ledgerloom.functions.names import stripped


def parsed(amount: Column) -> Column:
    """Whole dollars of an amount as people write it; null for none.

    A range counts as its first number; a number without a unit under 1000 is in millions.
    """
    s = stripped(F.lower(F.regexp_replace(amount, "[$€£₹,]", "")))
    s = F.regexp_replace(s, r"(?U)^(usd|us|eur|gbp|inr)\s*", "")
    s = F.regexp_replace(s, r"(?U)^(approximately|approx\.?|around|about|up\s+to|nearly|over|more\s+than|less\s+than|~)\s*", "")
    hidden = s.contains("undisclosed") | s.contains("unknown")
    one = F.regexp_replace(s, r"(?U)(\d+)\s*[-–—to]+\s*\d+", "$1")
    pattern = r"(?U)^([0-9.]+)\s*(million|mn|mm|m|billion|bn|b|thousand|k|crore|cr|lakh|lac)?"
    number = F.regexp_extract(one, pattern, 1).try_cast("double")
    unit = F.regexp_extract(one, pattern, 2)
    factor = F.create_map(*[F.lit(x) for kv in fixed.AMOUNT_UNITS.items() for x in kv])
    value = F.when(unit != "", number * F.try_element_at(factor, unit)).when(number < 1000, number * 1_000_000).otherwise(number)
    return F.when(~hidden & (F.coalesce(amount, F.lit("")) != ""), value.cast("long"))


def parsed_or_plain(amount: Column) -> Column:
    """``parsed``, for columns where most amounts are a number and a letter, as in $4.2M or $500,000: those are read without its patterns."""
    unit, number = F.right(amount, F.lit(1)), F.translate(amount, "$,KMB", "").try_cast("double")
    letters = {letter: fixed.AMOUNT_UNITS[letter.lower()] for letter in "MBK"}
    plain = F.when(F.lit(False), number)
    for letter, factor in letters.items():
        plain = plain.when(unit == letter, number * factor)
    plain = plain.when(number < 1000, number * 1_000_000).otherwise(number)
    return F.when(amount.rlike(r"\A\$[0-9][0-9,]*(?:\.[0-9]+)?[KMB]?\z"), plain.cast("long")).otherwise(apart(amount, parsed))


def is_real(amount: Column) -> Column:
    """Whether an amount is more than a placeholder."""
    low = stripped(F.lower(amount))
    none = low.isin(fixed.AMOUNT_PLACEHOLDERS) | low.rlike("|".join(fixed.AMOUNT_PLACEHOLDER_PARTS))
    return F.coalesce(~none & amount.rlike(r"\d"), F.lit(False))


def lower_bound(amount: Column) -> Column:
    """Registry amounts: the number before any dash, times the unit letter anywhere; 0 if there is none."""
    s = F.lower(F.regexp_replace(F.coalesce(amount, F.lit("")), r"[$,\s]", ""))
    factor = F.when(s.contains("b"), 1_000_000_000).when(s.contains("m"), 1_000_000).when(s.contains("k"), 1_000).otherwise(1)
    number = F.regexp_replace(F.element_at(F.split(F.regexp_replace(s, "[bmk]", ""), "-"), 1), "[^0-9.]", "").try_cast("double")
    return F.coalesce((number * factor).cast("long"), F.lit(0).cast("long"))


def exact(usd: Column) -> Column:
    """Legal amounts as people read them: $47.5M, $1.5B, $500,000."""

    def short(unit: int, letter: str) -> Column:
        n = F.round(usd.cast("decimal(38,6)") / F.lit(unit).cast("decimal(12,0)"), 2).cast("decimal(38,2)").cast("string")
        return F.concat(F.lit("$"), F.regexp_replace(F.regexp_replace(n, "0+$", ""), r"\.$", ""), F.lit(letter))

    return F.when(usd >= 1_000_000_000, short(1_000_000_000, "B")).when(usd >= 1_000_000, short(1_000_000, "M")).otherwise(F.concat(F.lit("$"), F.format_number(usd, 0)))


def bucket(usd: Column) -> Column:
    """Steps that widen with the amount; null under 250,000."""
    step = lambda size: F.floor(usd / size)
    return (
        F.when(usd < 250_000, F.lit(None).cast("long"))
        .when(usd < 1_000_000, step(250_000))
        .when(usd < 10_000_000, 4 + step(2_000_000))
        .when(usd < 100_000_000, 9 + step(20_000_000))
        .when(usd < 1_000_000_000, 14 + step(100_000_000))
        .otherwise(24 + step(500_000_000))
    )


def over_round_limit(usd: Column, round_type: Column) -> Column:
    """Whether an amount is more than its round usually brings."""
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.ROUND_LIMITS.items() for x in kv]), round_type)
    return F.coalesce((usd > 0) & (usd > limit), F.lit(False))


def token_cost(inputs: Column, outputs: Column, reads: Column, writes: Column) -> Column:
    """Dollars for so many tokens."""
    return F.round(sum((c * p for c, p in zip((inputs, outputs, reads, writes), fixed.TOKEN_PRICES, strict=True)), F.lit(0.0)) / 1_000_000, 6)


def extracted(amount: Column) -> Column:
    """Whole dollars of an extractor's amount: the first number anywhere, in billions or millions; without a unit under 1000 in millions."""
    s = F.trim(F.regexp_replace(F.lower(amount), r"approximately|around|about|up to|over|[~$]", ""))
    pattern = r"([\d,.]+)\s*(billion|b|million|m|mn)?"
    number = F.replace(F.regexp_extract(s, pattern, 1), F.lit(","), F.lit("")).try_cast("double")
    unit = F.regexp_extract(s, pattern, 2)
    value = F.when(unit.isin("billion", "b"), number * 1_000_000_000).when((unit != "") | (number < 1000), number * 1_000_000).otherwise(number)
    return value.cast("long")


def review_reason(usd: Column, round_type: Column, text: Column, low: Column | None = None) -> Column:
    """Why an amount over its round's limit has to be looked at: like a market's size in the text, or just large; null under the limit."""
    millions, low = usd / 1_000_000, F.lower(text) if low is None else low
    sizes = F.flatten(F.array(*[F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(1)), lambda x: x.try_cast("double")) for p in fixed.MARKET_SIZES]))
    like = F.filter(sizes, lambda b: F.abs(millions - b) < 1)
    return F.when(over_round_limit(usd, round_type), F.when(F.size(like) > 0, "market size").otherwise("over threshold"))
