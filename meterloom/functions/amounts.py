"""Columns that log formats and reports share: days, amounts and counts as a billing export writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How an export may write a day; a time with a zone is taken to UTC first.
PLAIN_DAYS = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd")
ZONED_DAY = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
NOISE = r"\$|,| | |USD|usd"


def day_of(said: Column) -> Column:
    """The day, as yyyy-MM-dd, of an export's date; null if it is none."""
    text = F.trim(said)
    plain = [F.to_date(F.try_to_timestamp(text, F.lit(p))) for p in PLAIN_DAYS]
    zoned = F.when(text.rlike(ZONED_DAY), F.to_date(F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone())))
    return F.date_format(F.coalesce(zoned, *plain), "yyyy-MM-dd")


def money(said: Column) -> Column:
    """An amount as accountants write it: with currency, separators, and brackets for a minus."""
    text = F.trim(said)
    minus = text.startswith("(") & text.endswith(")")
    bare = F.regexp_replace(F.when(minus, F.regexp_replace(text, r"^\(|\)$", "")).otherwise(text), NOISE, "")
    value = bare.try_cast("double")
    return F.when(bare != "", F.when(minus, -value).otherwise(value))


def whole(said: Column) -> Column:
    """A count with separators; null if there is none or it is no whole number."""
    bare = F.regexp_replace(F.trim(said), r",| | ", "")
    wide = bare.try_cast("double")
    return F.coalesce(bare.try_cast("long"), F.when(wide == F.floor(wide), wide.try_cast("long")))
