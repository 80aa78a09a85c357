from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockframe.plans import calendar


def test_weeks_begin_on_sunday():
    assert calendar.week_of(date(2019, 7, 28)) == calendar.week_of(date(2019, 7, 29)) != calendar.week_of(date(2019, 7, 27))
    assert calendar.week_of(date(1970, 1, 4)) == 0 and calendar.month_of(date(1970, 1, 1)) == 1


def test_ranges():
    assert calendar.blocks_between(["1995-01-01", "2001-08-05"], "month") == list(range(301, 381))
    # a start on the 26th and an end on the 4th leave out the last month
    assert calendar.blocks_between(("2019-05-26", "2019-08-04"), "month") == [593, 594, 595]
    assert len(calendar.blocks_between(["2023-12-31", "2024-01-28"], "week")) == 5
    for bad in (["1995-01-02", "2001-08-05"], ["2001-08-05", "1995-01-01"], ["1995-01-01"]):
        with pytest.raises(ValueError):
            calendar.blocks_between(bad, "month")


@settings(max_examples=3, deadline=None)
@given(st.lists(st.dates(date(1968, 1, 1), date(2043, 1, 1)), min_size=1, max_size=60))
def test_blocks_of_all_types_agree(spark, days):
    rows = spark.createDataFrame([(d, d.isoformat() + "T10:11:12.5Z") for d in days], "d date, s string").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    kinds = (("d", T.DateType()), ("s", T.StringType()), ("ts", T.TimestampNTZType()))
    for block in calendar.BLOCKS:
        got = rows.select("d", *(calendar.as_block(F.col(c), k, block).alias(f"{c}_b") for c, k in kinds)).collect()
        for r in got:
            assert r.d_b == r.s_b == r.ts_b == calendar.block_of(r.d, block)
            text = spark.range(1).select(calendar.shown(F.lit(r.d_b), block).alias("x")).first().x if r is got[0] else None
            if text:
                assert text == (r.d.strftime("%Y-%m") if block == "month" else (date(1970, 1, 4) + timedelta(7 * r.d_b)).isoformat())
