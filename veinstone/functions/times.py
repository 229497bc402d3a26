"""Date and time functions on columns. Timestamps are taken in the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def next_half_hour(t: Column) -> Column:
    """The next full or half hour after t; exactly on one, the one after it."""
    return F.date_trunc("hour", t) + F.when(F.minute(t) < 30, F.expr("interval 30 minutes")).otherwise(F.expr("interval 60 minutes"))


def seconds_until_next_half_hour(t: Column, least: int = 5, most: int = 1800) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), F.unix_timestamp(next_half_hour(t)) - F.unix_timestamp(t)))


def open_now(hours: Column, now: Column, closed_note: Column) -> Column:
    """Whether the first entry is open now, both ends included; false without hours."""
    first = F.get(hours, F.lit(0))
    return F.coalesce(closed_note.isNull() & first["open"] & (first["opens_at"] <= now) & (now <= first["closes_at"]), F.lit(False))


def next_open(hours: Column, now: Column, closed_note: Column) -> Column:
    later = F.filter(hours, lambda h: h["open"] & (h["opens_at"] > now) & (h["closes_at"] > now))
    return F.when(closed_note.isNull(), F.get(later, F.lit(0)))


def hours_today(hours: Column, closed_note: Column) -> Column:
    """The first entry, open or not."""
    return F.when(closed_note.isNull(), F.get(hours, F.lit(0)))


def parse_hours(body: Column) -> Column:
    """Opening hours from the feed's JSON; anything malformed gives an empty list."""
    shape = "data struct<attributes: struct<hours: array<struct<open: boolean, opens_at: string, closes_at: string>>>>"
    rows = F.from_json(body, shape)["data"]["attributes"]["hours"]
    return F.coalesce(F.transform(rows, lambda h: F.struct(h["open"].alias("open"), F.to_timestamp(h["opens_at"]).alias("opens_at"), F.to_timestamp(h["closes_at"]).alias("closes_at"))), F.array().cast("array<struct<open: boolean, opens_at: timestamp, closes_at: timestamp>>"))


def week_range(day: Column) -> Column:
    return F.struct(day.alias("first"), F.date_add(day, 7).alias("last"))


def clock(t: Column, today: Column) -> Column:
    """12-hour time, minutes only when there are any, and the weekday beyond tomorrow."""
    hour = F.concat(F.date_format(t, "h"), F.when(F.minute(t) != 0, F.date_format(t, ":mm")).otherwise(""), F.when(F.hour(t) >= 12, "pm").otherwise("am"))
    days = F.datediff(t, today)
    return F.when(days.isin(0, 1), hour).otherwise(F.concat(hour, F.lit(" "), F.date_format(t, "EEEE")))


def days_ago(now: Column, days: int) -> Column:
    return F.date_format(F.date_sub(now, days), "yyyy-MM-dd")


def long_date(day: Column) -> Column:
    return F.date_format(day, "MMMM dd, yyyy")


def cutoff(now: Column, months: int = 0, days: int = 0) -> Column:
    return now - F.make_interval(months=F.lit(months), days=F.lit(days))


def years_of(normal: Column) -> Column:
    """array<int> of the years in a normalised range such as 1963/1972 or 1963-01-02; null without a year."""
    first, last = (F.regexp_extract(normal, p, 1).try_cast("int") for p in (r"^(\d{4})", r"/(\d{4})"))
    return F.when(first.isNotNull(), F.sequence(first, F.greatest(first, F.coalesce(last, first))))
