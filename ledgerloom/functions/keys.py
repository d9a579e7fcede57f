"""Keys under which deals count as the same."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import amounts, names

#: Days in a date bucket of dated deals, and of undated ones.
DAYS, UNDATED_DAYS = 3, 30


def day_bucket(date: Column) -> Column:
    return F.floor(F.unix_date(date) / DAYS)


def _bucket_text(date: Column, as_of: datetime.date, shift: int = 0) -> Column:
    undated = (as_of - datetime.date(1970, 1, 1)).days // UNDATED_DAYS + shift
    return F.coalesce((day_bucket(date) + shift).cast("string"), F.lit(f"nodate_{undated}"))


def dedup_key_of(norm: Column, round_type: Column, date: Column, as_of: datetime.date, shift: int = 0) -> Column:
    """md5 of normal form, round and date bucket; ``shift`` gives that of a neighbouring bucket."""
    return F.md5(F.concat_ws("|", norm, round_type, _bucket_text(date, as_of, shift)))


def amount_key_of(norm: Column, usd: Column, date: Column, as_of: datetime.date) -> Column:
    """md5 of normal form, amount bucket and date bucket; null without an amount of 250,000 or more."""
    b = amounts.bucket(usd)
    return F.when(b.isNotNull(), F.md5(F.concat_ws("|", norm, F.concat(F.lit("amt"), b.cast("string")), _bucket_text(date, as_of))))


def adjacent_keys_of(norm: Column, round_type: Column, date: Column, as_of: datetime.date) -> Column:
    return F.array(dedup_key_of(norm, round_type, date, as_of, -1), dedup_key_of(norm, round_type, date, as_of, 1))


def dedup_key(name: Column, round_type: Column, date: Column, as_of: datetime.date, shift: int = 0) -> Column:
    return dedup_key_of(names.normal_form(name), round_type, date, as_of, shift)


def amount_key(name: Column, usd: Column, date: Column, as_of: datetime.date) -> Column:
    return amount_key_of(names.normal_form(name), usd, date, as_of)


def adjacent_keys(name: Column, round_type: Column, date: Column, as_of: datetime.date) -> Column:
    return adjacent_keys_of(names.normal_form(name), round_type, date, as_of)
