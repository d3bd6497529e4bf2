"""How long until something closes, or since it happened, in words; ends of periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from which on a closing isn't urgent any more, and the days of a period.
URGENT_DAYS = 3
PERIOD_DAYS = {"monthly": 30, "yearly": 365}


def _seconds(a: Column, b: Column) -> Column:
    return F.unix_millis(b.cast("timestamp")) / 1000 - F.unix_millis(a.cast("timestamp")) / 1000


def to_millis(at: Column) -> Column:
    """A moment to the nearest millisecond, halves up."""
    micros = F.unix_micros(at.cast("timestamp")) + 500
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(1000)))


def closes_in(closes: Column, now: Column) -> Column:
    """(text, urgent, closed): 'Closed', 'Closes within an hour', 'Closes in 5h', 'Closes in 2 days'."""
    left = _seconds(now, closes)
    hours = F.floor(left / 3600)
    days = F.floor(hours / 24)
    said = F.when(left < 0, "Closed").when(hours < 1, "Closes within an hour").when(hours < 24, F.format_string("Closes in %dh", hours)).when(days == 1, "Closes in 1 day").otherwise(F.format_string("Closes in %d days", days))
    return F.when(left.isNotNull(), F.struct(said.alias("text"), ((left >= 0) & ((hours < 24) | (days <= URGENT_DAYS))).alias("urgent"), (left < 0).alias("closed")))


def countdown(closes: Column, now: Column) -> Column:
    """Time left for a table: '16d 04h', '5h 12m', '< 1m', 'Closed'."""
    left = _seconds(now, closes)
    minutes = F.floor(left / 60)
    days, hours = F.floor(minutes / 1440), F.floor((minutes % 1440) / 60)
    return F.when(left < 0, "Closed").when(days > 0, F.format_string("%dd %02dh", days, hours)).when(minutes < 1, "< 1m").when(left.isNotNull(), F.format_string("%dh %02dm", hours, minutes % 60))


def time_ago(at: Column, now: Column) -> Column:
    """'never', 'just now', '5 min ago', '3 h ago', '2 days ago'; halves count up."""
    whole = lambda x: F.floor(x + 0.5)
    minutes = whole(_seconds(at, now) / 60)
    hours = whole(minutes / 60)
    days = whole(hours / 24)
    return F.when(minutes.isNull(), "never").when(minutes < 1, "just now").when(minutes < 60, F.format_string("%d min ago", minutes)).when(hours < 24, F.format_string("%d h ago", hours)).when(days == 1, "1 day ago").otherwise(F.format_string("%d days ago", days))


def period_end(start: Column, interval: Column) -> Column:
    """When a period that begins then is over; an interval that isn't known is a month."""
    days = F.create_map(*[F.lit(x) for kv in PERIOD_DAYS.items() for x in kv])
    return start.cast("timestamp") + F.make_interval(days=F.coalesce(days[interval], F.lit(PERIOD_DAYS["monthly"])))
