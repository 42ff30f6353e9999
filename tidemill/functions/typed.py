"""Typed reading of texts: NULL where a text is not of the type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t"
NUMERAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
EPOCH = r"^[0-9]{12,13}$"
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,9})?)?(Z|z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def number(text: Column) -> Column:
    """A decimal numeral with optional sign and exponent, outer blanks allowed. No NaN, infinity or suffix; a
    numeral too large for a double gives NULL as well."""
    bare = F.btrim(text, F.lit(BLANKS))
    value = F.when(bare.rlike(NUMERAL), bare.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def instant(text: Column) -> Column:
    """Epoch ms of 12 or 13 digits, or an existing ISO date, alone or with a valid time (UTC unless it has an
    offset); outer blanks allowed. As a timestamp."""
    bare = F.btrim(text, F.lit(BLANKS))
    stamp = F.when(bare.rlike(EPOCH), F.timestamp_millis(bare.try_cast("long")))
    day = F.substring(bare, 1, 10).try_cast("date")
    spelt = F.regexp_replace(F.upper(bare), ",", ".")
    clock = F.regexp_extract(spelt, r"^.{10}[T ]([0-9:.]+)", 1)
    hour, minute = F.substring(clock, 1, 2).try_cast("int"), F.substring(clock, 4, 2).try_cast("int")
    second = F.coalesce(F.substring(clock, 7, 2).try_cast("int"), F.lit(0))
    offset = F.regexp_extract(spelt, r"([+-])([0-9]{2}):?([0-9]{2})$", 0)
    has_clock = F.length(clock) > 0
    offset = F.when(has_clock & (F.length(offset) >= 5), offset).otherwise("")
    off_minutes = F.substring(offset, 2, 2).try_cast("int") * 60 + F.regexp_extract(offset, r"([0-9]{2})$", 1).try_cast("int")
    off_ms = F.coalesce(off_minutes, F.lit(0)) * 60_000 * F.when(offset.startswith("-"), -1).otherwise(1)
    fraction = F.regexp_extract(clock, r"\.([0-9]+)$", 1)
    ms = F.coalesce(F.rpad(fraction, 3, "0").substr(1, 3).try_cast("int"), F.lit(0))
    valid_clock = ~has_clock | ((hour < 24) & (minute < 60) & (second < 60))
    valid_offset = F.coalesce(off_minutes <= 14 * 60, F.lit(True))
    of_day = F.when(has_clock, ((hour * 60 + minute) * 60 + second).cast("long") * 1000 + ms).otherwise(0)
    epoch_ms = F.unix_date(day).cast("long") * 86_400_000 + of_day - off_ms
    iso = F.when(bare.rlike(ISO) & day.isNotNull() & valid_clock & valid_offset, F.timestamp_millis(epoch_ms))
    return F.coalesce(stamp, iso)
