"""Time blocks: calendar months counted from January 1970 = 1, or weeks from Sunday, 4 January 1970 = 0."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUNDAY = date(1970, 1, 4)
BLOCKS = ("month", "week")


def month_of(d: date) -> int:
    return (d.year - 1970) * 12 + d.month


def week_of(d: date) -> int:
    return (d - SUNDAY).days // 7


def block_of(d: date, kind: str) -> int:
    return month_of(d) if kind == "month" else week_of(d)


def blocks_between(dates: list | tuple, kind: str) -> list[int]:
    """Blocks of a range of two Sundays (texts), by steps of one block from the start."""
    if len(dates) != 2:
        raise ValueError("a range has two dates")
    start, end = (date.fromisoformat(x) if isinstance(x, str) else x for x in dates)
    if start.weekday() != 6 or end.weekday() != 6:
        raise ValueError("a range starts and ends on a Sunday")
    if start >= end:
        raise ValueError("a range starts before its end")
    if kind == "week":
        return list(range(week_of(start), week_of(end) + 1))
    # a month counts if the start's day of it is not past the end, so the last one may not
    last = month_of(end) - (start.day > end.day)
    return list(range(month_of(start), last + 1))


def as_date(value: Column, kind: T.DataType, block: str) -> Column:
    """A date from a timestamp, a date, an ISO text, or a block's number."""
    if isinstance(kind, T.StringType):
        # the date part decides a block, and is all that month texts lack a day of
        text = F.when(F.length(value) == 7, F.concat(value, F.lit("-01"))).otherwise(F.substring(value, 1, 10))
        return F.try_to_date(text, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    if isinstance(kind, T.IntegralType):
        number = value.cast("int")
        return F.add_months(F.lit(date(1970, 1, 1)), number - 1) if block == "month" else F.date_add(F.lit(SUNDAY), number * 7)
    return value.cast("date")


def as_block(value: Column, kind: T.DataType, block: str) -> Column:
    """The block's number of a date in any form; numbers are blocks already."""
    if isinstance(kind, T.IntegralType):
        return value.cast("int")
    d = as_date(value, kind, block)
    if block == "month":
        return ((F.year(d) - 1970) * 12 + F.month(d)).cast("int")
    return F.floor(F.datediff(d, F.lit(SUNDAY)) / F.lit(7)).cast("int")


def shown(value: Column, block: str) -> Column:
    """A block's text: its month, or its Sunday."""
    d = as_date(value, T.IntegerType(), block)
    return F.date_format(d, "yyyy-MM" if block == "month" else "yyyy-MM-dd")
