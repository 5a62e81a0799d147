"""Post-listing returns, horizons and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calendar days from listing to each horizon's target date. Fixed values.
HORIZONS = {"1W": 7, "1M": 30, "6M": 180}


def iso_date(text: Column) -> Column:
    """Date of an ISO date or timestamp; what follows a T is dropped."""
    return F.to_date(F.split_part(text, F.lit("T"), F.lit(1)))


def target_date(listing: Column, horizon: Column) -> Column:
    days = F.create_map(*[x for k, v in HORIZONS.items() for x in (F.lit(k), F.lit(v))])
    return F.date_add(listing, F.try_element_at(days, horizon))


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def last_weekday(day: Column, back: int = 29) -> Column:
    """The day itself or the last weekday before it."""
    return F.array_max(F.filter(F.sequence(F.date_sub(day, back), day), is_weekday))


def _percent(now: Column, then: Column) -> Column:
    return F.round((now - then) / then * 100.0, 6)


def listing_gain(opened: Column, issue: Column) -> Column:
    """Percent; null without an opening price, an error for an issue price of 0 or less."""
    checked = F.when(issue <= 0, F.raise_error(F.lit("issue price must be positive")).cast("double")).otherwise(issue)
    return F.when(opened.isNotNull(), _percent(opened, checked))


def adjusted_close(close: Column, factor: Column) -> Column:
    return F.round(close * factor, 6)


def effective_factor(recorded: Column, given: Column) -> Column:
    """The record's factor if it differs from 1 and the caller's doesn't; else the caller's."""
    return F.when((recorded != 1.0) & (given == 1.0), recorded).otherwise(given)


def simple_return(now: Column, then: Column) -> Column:
    """Percent; null if either is missing or the start isn't positive."""
    return F.when(then > 0, _percent(now, then))


def excess(absolute: Column, benchmark: Column) -> Column:
    return F.round(absolute - benchmark, 6)


def age_hours(moment: Column, as_of: Column) -> Column:
    return (F.unix_micros(moment) - F.unix_micros(as_of)) / 3.6e9


def age_days(moment: Column, as_of: Column) -> Column:
    return (F.unix_micros(moment) - F.unix_micros(as_of)) / 8.64e10


def has_offset(text: Column) -> Column:
    return text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")


def months_before(day: Column, months: int) -> Column:
    return F.add_months(day, -months)


def premium(value: Column, median: Column) -> Column:
    """Percent over a median; null for a missing or zero median."""
    return F.try_divide((value - median) * 100.0, median)


def rescored(scores: list[tuple[Column, float, float]]) -> Column:
    """Sum of score / max * new weight; a missing score counts 0; 2 places."""
    total = F.lit(0.0)
    for score, most, weight in scores:
        total = total + F.coalesce(score, F.lit(0.0)) / most * weight
    return F.round(total, 2)
