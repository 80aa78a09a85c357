"""Functions of dates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.calendar import as_block, as_date
from ..plans.planner import function

INT = T.IntegerType()


@function("DATE", 1, pack="datetime")
def date(p, table, tree):
    return p.mapped(table, tree, lambda v, k: as_block(v, k, p.block), INT, -1)


@function("CMONTH", 1, pack="default")
def cmonth(p, table, tree):
    return p.mapped(table, tree, lambda v, k: as_block(v, k, "month"), INT, None)


@function("CMONTHSINCE", 1, pack="default")
def cmonth_since(p, table, tree):
    now = F.lit(p.now).cast("timestamp_ntz") if p.now is not None else F.localtimestamp()

    def months(v, k):
        at = F.try_to_timestamp(v).cast("timestamp_ntz") if isinstance(k, T.StringType) else v.cast("timestamp_ntz")
        days = F.floor(F.timestamp_diff("SECOND", at, now) / F.lit(86400))
        return F.coalesce(F.bround(days / F.lit(30)).cast("int"), F.lit(-99999))

    return p.mapped(table, tree, months, INT, -99999)


@function("DT_DAY_OF_THE_WEEK", 1, pack="datetime")
def day_of_week(p, table, tree):
    return p.mapped(table, tree, lambda v, k: F.weekday(as_date(v, k, p.block)) + 1, INT, -1)


@function("DT_DAY_OF_THE_MONTH", 1, pack="datetime")
def day_of_month(p, table, tree):
    return p.mapped(table, tree, lambda v, k: F.dayofmonth(as_date(v, k, p.block)), INT, -1)


@function("DT_MONTH_OF_THE_YEAR", 1, pack="datetime")
def month_of_year(p, table, tree):
    return p.mapped(table, tree, lambda v, k: F.month(as_date(v, k, p.block)), INT, -1)
