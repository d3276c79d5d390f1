"""Dates and ages; every age is measured against an explicit moment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.functions.text import js_round

YEAR_SECONDS = 365.25 * 86_400


def stamp_to_timestamp(stamp: Column) -> Column:
    """``yyyyMMdd[HHmmss]`` to a timestamp; missing parts are zero."""
    return F.try_to_timestamp(F.rpad(stamp, 14, "0"), F.lit("yyyyMMddHHmmss"))


def age_years(start: Column, as_of: Column) -> Column:
    """Years of 365.25 days, one decimal."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(start)
    return js_round(seconds / F.lit(YEAR_SECONDS) * 10) / 10
