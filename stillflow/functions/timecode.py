"""Timestamps as text and back, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def parse_timestamp(text: Column) -> Column:
    """Seconds of [[H:]MM:]SS[.sss]; parts are unbounded. Null for text that is empty, has over three parts, or a part that is not a number from 0 up."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.trim(p))
    fine = (F.size(parts) <= 3) & F.forall(parts, lambda p: p.rlike(_NUMBER))
    total = F.aggregate(parts, F.lit(0.0), lambda sum_, p: sum_ * 60.0 + F.coalesce(p.try_cast("double"), F.lit(0.0)))
    return F.when(fine, total)


def _digits(value: Column, width: int) -> Column:
    # Not lpad, which cuts what is longer.
    return F.format_string(f"%0{width}d", value)


def format_timestamp(seconds: Column) -> Column:
    """[H:]MM:SS.mmm; below 0 counts as 0, and 1000 ms carry."""
    value = F.greatest(seconds.cast("double"), F.lit(0.0))
    ms = F.bround((value - F.floor(value)) * 1000).cast("bigint")
    whole = F.floor(value) + F.when(ms == 1000, 1).otherwise(0)
    ms = F.when(ms == 1000, 0).otherwise(ms)
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    base = F.concat(_digits(m, 2), F.lit(":"), _digits(s, 2), F.lit("."), _digits(ms, 3))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), base)).otherwise(base)


def format_hms(seconds: Column) -> Column:
    """[H:M]M:SS of whole seconds, for estimates of time left."""
    whole = F.floor(F.greatest(seconds.cast("double"), F.lit(0.0)))
    h, m, s = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), _digits(m, 2), F.lit(":"), _digits(s, 2))).otherwise(F.concat(m.cast("string"), F.lit(":"), _digits(s, 2)))
