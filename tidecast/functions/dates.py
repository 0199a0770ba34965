"""Date expressions. Weekdays count from Monday = 0; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday(d: Column) -> Column:
    return F.weekday(d)


def is_weekday(d: Column) -> Column:
    return F.weekday(d) < 5


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def week_of_month(d: Column) -> Column:
    """1 plus the number of Sundays after the first of the month, up to ``d``."""
    first = month_start(d)
    return (F.floor((F.datediff(d, first) + F.dayofweek(first) - 1) / 7) + 1).cast("int")


def business_day_add(d: Column, n: Column | int) -> Column:
    """Step ``n`` weekdays from ``d`` (holidays count as weekdays), in closed form.

    Forward steps start from the Friday before a weekend, backward steps from the
    Monday after it; each full block of five weekdays then skips two extra days.
    """
    n = F.lit(n) if isinstance(n, int) else n
    w = F.weekday(d)
    fri = F.date_add(d, -F.greatest(w - 4, F.lit(0)))
    w_fri = F.least(w, F.lit(4))
    forward = F.date_add(fri, (n + 2 * F.floor((w_fri + n) / 5)).cast("int"))
    back = -n
    mon = F.date_add(d, F.when(w >= 5, 7 - w).otherwise(0))
    w_mon = F.when(w >= 5, 0).otherwise(w)
    backward = F.date_add(mon, (-(back + 2 * F.floor((4 - w_mon + back) / 5))).cast("int"))
    return F.when(n > 0, forward).when(n < 0, backward).otherwise(d)


def months_spanned(a: Column, b: Column) -> Column:
    """Number of calendar months touched by [a, b]."""
    return (
        (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) + 1
    ).cast("int")


def nth_weekday_of_month(year: Column, month: Column, nth: Column, dow: Column) -> Column:
    """``nth`` weekday ``dow`` of a month; ``nth = -1`` means the last one."""
    first = F.make_date(year, month, F.lit(1))
    last = F.last_day(first)
    from_start = F.date_add(
        first, ((dow - F.weekday(first) + 7) % 7 + 7 * (nth - 1)).cast("int")
    )
    from_end = F.date_sub(last, ((F.weekday(last) - dow + 7) % 7).cast("int"))
    return F.when(nth > 0, from_start).otherwise(from_end)
