"""Scalar column functions. Days are offsets from the course start, negative before it; a week is floor(day / 7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: seconds of 2000-01-06, a whole number of weeks after 1970-01-01, so that 7-day windows start on day 0
EPOCH_SECONDS = 947_116_800
PASSED = ("Pass", "Distinction")
UNSUCCESSFUL = ("Fail", "Withdrawn")
PASS_SCORE = 40


def week_of(day: Column) -> Column:
    """Week of a day; day -1 lies in week -1."""
    return F.floor(day / 7).cast("int")


def first_day(week: Column) -> Column:
    return (week * 7).cast("int")


def last_day(week: Column) -> Column:
    return (week * 7 + 6).cast("int")


def enrolled_at(unregistered: Column, day: Column) -> Column:
    """Still enrolled at the end of ``day``."""
    return unregistered.isNull() | (unregistered > day)


def flag(condition: Column) -> Column:
    """A condition that is never null."""
    return F.coalesce(condition, F.lit(False))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def half_up(x: Column, places: int) -> Column:
    """Rounds on doubles by floor(x * 10^n + 0.5) / 10^n, which every engine computes alike."""
    return F.floor(x.cast("double") * 10.0**places + 0.5) / F.lit(10.0**places)


def percent(part: Column, whole: Column, places: int | None = 1) -> Column:
    """100 * part / whole on doubles; null when whole is 0."""
    rate = F.try_divide(100.0 * part.cast("double"), whole.cast("double"))
    return rate if places is None else half_up(rate, places)


def offering_label(module: Column, presentation: Column) -> Column:
    return F.concat_ws(" ", module, presentation)


def year_of(presentation: Column) -> Column:
    return F.substring(presentation, 1, 4).try_cast("int")


def semester_of(presentation: Column) -> Column:
    return F.substring(presentation, 5, 1)


def weeks_in(length: Column) -> Column:
    return (F.floor((length - 1) / 7) + 1).cast("int")


def repaired_band(band: Column) -> Column:
    """Adds the missing percent sign; null becomes Unknown."""
    return F.when(band.isNull(), "Unknown").when(band == "10-20", "10-20%").otherwise(band)


def risk_level(score: Column) -> Column:
    return F.when(score >= 3, "high").when(score == 2, "medium").otherwise("low")


def percentile_band(rank: Column) -> Column:
    return F.when(rank >= 75, "top quarter").when(rank >= 25, "middle half").when(rank.isNotNull(), "bottom quarter")


def event_time(day: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH_SECONDS) + day.cast("long") * 86_400)


def week_of_window(window: Column) -> Column:
    """Week number of a 7-day event-time window."""
    return ((F.unix_timestamp(window["start"]) - EPOCH_SECONDS) / 604_800).cast("int")


def fisher_interval(rho: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95 percent interval of a correlation: null up to three pairs, rho itself at +-1."""
    half = z / F.sqrt(F.greatest(n - 3, F.lit(1)).cast("double"))
    whole = F.abs(rho) >= 1
    bound = lambda side: F.when(rho.isNull() | (n <= 3), None).when(whole, rho).otherwise(F.tanh(F.atanh(F.when(~whole, rho)) + side * half))
    return bound(-1.0), bound(1.0)
