"""Dates as exports write them, weeks that begin on Sunday, and Sunday-to-Thursday days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_CLOCK = r"(?:[ t:]+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}(?:\.[0-9]+)?))?)?Z?$"
#: Shapes of times in lower case, and which groups of theirs are year, month and day; hours, minutes and seconds follow.
_SHAPES = (
    (r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})" + _CLOCK, (1, 2, 3)),
    (r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})" + _CLOCK, (3, 2, 1)),
    (r"^([0-9]{1,2})([a-z]{3})([0-9]{4})" + _CLOCK, (3, 2, 1)),
)


def _shaped(low: Column, shape: str, y: int, m: int, d: int) -> Column:
    part = lambda i: F.regexp_extract(low, shape, i)
    number = lambda i: F.when(part(i) != "", part(i)).otherwise("0")
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), part(m)) if "[a-z]" in shape else number(m)
    whole = [number(y), month, number(d), number(4), number(5)]
    made = F.try_make_timestamp_ntz(*[x.cast("int") for x in whole], number(6).cast("decimal(16,6)"))
    return F.when(low.rlike(shape), made)


def parse_timestamp(text: Column, date1904: bool = False) -> Column:
    """A timestamp without zone from any of the shapes, a spreadsheet's day number or SAS seconds; else null.

    Numbers above ten million are seconds since 1960, others days since 1899-12-30, or since 1904-01-01 in workbooks
    that count from there.  No zone has a part in it, so that no hour is missing in spring.
    """
    low = F.lower(F.trim(text))
    found = [_shaped(low, shape, *order) for shape, order in _SHAPES]
    number = F.when(low.rlike(r"^[0-9]+(\.[0-9]+)?$"), low.cast("double"))
    day_zero, sas_zero = (F.lit(x).cast("timestamp_ntz") for x in ("1904-01-01" if date1904 else "1899-12-30", "1960-01-01"))
    seconds = F.round(F.when(number > 1e7, number).otherwise(number * 86400)).cast("long")
    shifted = F.when(number > 1e7, sas_zero).otherwise(day_zero) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.when(number.isNotNull(), shifted).otherwise(F.coalesce(*found))


def granularity(first: Column, last: Column) -> Column:
    """Days up to three weeks, weeks up to 26, else months: the unit in which a span of days is shown."""
    days = F.abs(F.datediff(last, first))
    return F.when(days <= 21, "day").when(days <= 182, "week").otherwise("month")


def period_start(day: Column, unit: Column) -> Column:
    """The day, the Sunday on or before it, or the first of its month."""
    return F.when(unit == "day", day).when(unit == "week", week_start(day)).otherwise(F.trunc(day, "month"))


def week_start(day: Column) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def add_business_days(at: Column, n: int) -> Column:
    """The time n Sunday-to-Thursday days later, at the same time of day.

    Friday and Saturday are no such days: from there, counting starts on Thursday.
    """
    d = F.dayofweek(at)  # 1 is Sunday, 6 Friday, 7 Saturday
    back = F.when(d == 6, 1).when(d == 7, 2).otherwise(0)
    from_day = F.when(d >= 6, 5).otherwise(d)
    weekends = F.floor((from_day - 1 + n) / 5)
    days = F.when(F.lit(n) > 0, n + 2 * weekends - back).otherwise(F.lit(0))
    return at + F.make_dt_interval(days=days.cast("int"))
