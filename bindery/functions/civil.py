"""Lenient civil dates and times. They are structs: a book's date has no zone and may lie outside what a timestamp holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

_DATE = "^[^0-9]*([0-9]{1,4})(?:[^0-9]*([0-9]{1,2})(?:[^0-9]*([0-9]{1,2}))?)?"
_TIME = "^[^0-9Z+-]*([0-9]{1,2})(?:[^0-9Z+-]*([0-9]{1,2})(?:[^0-9Z+-]*([0-9]{1,2}))?)?"
_OFFSET = _TIME + "[^Z+-]*(Z|[+-])(?:[^0-9Z+-]*([0-9]{1,2})(?:[^0-9Z+-]*([0-9]{1,2}))?)?"


def _number(x: Column, default: int, low: int, high: int) -> Column:
    return F.least(F.greatest(F.coalesce(x.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def date(x: Column) -> Column:
    """struct<year, month, day>: up to 4, 2 and 2 digits wherever they stand; missing ones are 1; null without a digit."""
    part = lambda k: F.regexp_extract(x, _DATE, k)
    out = F.struct(_number(part(1), 1, 0, 9999).alias("year"), _number(part(2), 1, 1, 12).alias("month"), _number(part(3), 1, 1, 31).alias("day"))
    return F.when(x.rlike("[0-9]"), out)


def time(x: Column) -> Column:
    """struct<hour, minute, second, offset>: the offset in minutes, null for local time; null where no hour comes first."""
    part = lambda k: F.regexp_extract(x, _TIME, k)
    zone = lambda k: F.regexp_extract(x, _OFFSET, k)
    minutes = _number(zone(5), 0, 0, 99) * 60 + _number(zone(6), 0, 0, 99)
    signed = F.when(zone(4) == "-", -minutes).otherwise(minutes)
    offset = F.when(zone(4) == "Z", 0).when(zone(4).isin("+", "-"), F.least(F.greatest(signed, F.lit(-720)), F.lit(840)))
    out = F.struct(_number(part(1), 0, 0, 23).alias("hour"), _number(part(2), 0, 0, 59).alias("minute"), _number(part(3), 0, 0, 59).alias("second"), offset.cast("int").alias("offset"))
    return F.when(x.rlike(_TIME), out)


def date_time(x: Column) -> Column:
    """struct<date, time>: parted at the first T or space; a time that cannot be read is midnight, local; null without a date."""
    x = trimmed(x)
    midnight = F.struct(F.lit(0).alias("hour"), F.lit(0).alias("minute"), F.lit(0).alias("second"), F.lit(None).cast("int").alias("offset"))
    d, t = date(F.regexp_extract(x, "^[^T ]*", 0)), time(F.regexp_extract(x, "(?s)^[^T ]*[T ](.*)$", 1))
    return F.when(d.isNotNull(), F.struct(d.alias("date"), F.coalesce(t, midnight).alias("time")))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def show_date(d: Column) -> Column:
    return F.concat_ws("-", F.lpad(d["year"].cast("string"), 4, "0"), _two(d["month"]), _two(d["day"]))


def show_time(t: Column) -> Column:
    size = F.abs(t["offset"])
    zone = F.when(t["offset"].isNull(), "").when(t["offset"] == 0, "Z").otherwise(F.concat(F.when(t["offset"] < 0, "-").otherwise("+"), _two(F.floor(size / 60)), F.lit(":"), _two(size % 60)))
    return F.concat(F.concat_ws(":", _two(t["hour"]), _two(t["minute"]), _two(t["second"])), zone)


def show(dt: Column) -> Column:
    return F.when(dt.isNotNull(), F.concat(show_date(dt["date"]), F.lit("T"), show_time(dt["time"])))


def from_unix(seconds: Column) -> Column:
    """UTC, whatever the session's zone is."""
    days = F.floor(seconds / 86400)
    left = (seconds - days * 86400).cast("int")
    day = F.date_from_unix_date(days.cast("int"))
    d = F.struct(F.year(day).alias("year"), F.month(day).alias("month"), F.dayofmonth(day).alias("day"))
    t = F.struct(F.floor(left / 3600).cast("int").alias("hour"), (F.floor(left / 60) % 60).cast("int").alias("minute"), (left % 60).cast("int").alias("second"), F.lit(0).alias("offset"))
    return F.struct(d.alias("date"), t.alias("time"))


def now() -> Column:
    """The system's clock, UTC; one instant for a whole query."""
    return from_unix(F.unix_timestamp(F.current_timestamp()))


def new_date(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    """A date of numbers, each brought into its range; a month or day that is not given is 1."""
    at = lambda x, low, high: F.least(F.greatest(x.cast("int"), F.lit(low)), F.lit(high))
    one = F.lit(1)
    return F.struct(at(year, 0, 9999).alias("year"), at(one if month is None else month, 1, 12).alias("month"), at(one if day is None else day, 1, 31).alias("day"))


def new_time(hour: Column, minute: Column, second: Column, offset: Column | None = None) -> Column:
    """A time of numbers, each brought into its range; without an offset (minutes) it is local."""
    at = lambda x, low, high: F.least(F.greatest(x.cast("int"), F.lit(low)), F.lit(high))
    zone = F.lit(None).cast("int") if offset is None else F.when(offset.isNotNull(), at(offset, -720, 840))
    return F.struct(at(hour, 0, 23).alias("hour"), at(minute, 0, 59).alias("minute"), at(second, 0, 59).alias("second"), zone.alias("offset"))


def new(date_: Column, time_: Column) -> Column:
    return F.struct(date_.alias("date"), time_.alias("time"))


def version(x: Column) -> Column:
    """struct<major, minor> of the first two parts, each 0 to 65535; further parts are ignored; null where one is no number."""
    parts = F.split(trimmed(x), r"\.")
    number = lambda k: F.when(F.get(parts, F.lit(k)).rlike(r"^\+?[0-9]{1,9}$"), F.get(parts, F.lit(k)).try_cast("int"))
    major, minor = number(0), F.when(F.size(parts) > 1, number(1)).otherwise(0)
    good = major.between(0, 65535) & minor.between(0, 65535)
    return F.when(good, F.struct(major.alias("major"), minor.alias("minor")))
