"""Functions over an entity's sequence of time blocks. They work on the result's own blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.grid import Grid
from ..plans.calendar import as_block
from ..plans.model import Frame, PlanError, col, truthy
from ..plans.planner import function
from .aggregates import number

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing
LONG, INT, DOUBLE, BOOL = T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def sequence(p, table, tree, make, kind=None, fill=0) -> Frame:
    """make(v, type, w): v the value's column on the grid, w the window by entity in order of blocks."""
    if p.output is None or table is not p.output:
        raise PlanError(f"{tree.function} works on the result's blocks, not in table {table.name}")
    frame = p.frame(table, p.value(table, tree.args[0]))
    on = frame.joined_on()
    if all(c != table.date for _, c in on):
        raise PlanError(f"{tree.args[0].name} has no date among its groups")
    grid = p.source(("grid", frame.source.id, tuple(on)), lambda: Grid(frame.source, on, table))
    name = grid.input(frame.value)
    out = grid.output(tree.name, lambda w: make(col(name), frame.type, w), name if frame.sparse else None)
    return Frame(grid, out, kind or frame.type, tree.name, fill, {c: c for c in grid.pivots}, table.name)


def seen(v, k):
    return F.when(truthy(v, k), v)


def zeroed(v, k):
    return F.coalesce(v, F.lit(0).cast(k if isinstance(k, T.NumericType) else DOUBLE))


def added(k):
    """Sums of whole numbers stay whole."""
    return LONG if isinstance(k, T.IntegralType) else DOUBLE


def _with_type(p, table, tree, make, kind_of, fill):
    frame = p.frame(table, p.value(table, tree.args[0]))
    return sequence(p, table, tree, make, kind_of(frame.type), fill)


@function("ACCUMULATE", (1, 2), pack="counts")
def accumulate(p, table, tree):
    n = number(tree.args[1]) if len(tree.args) > 1 else 100000
    back = FIRST if n <= 0 or n != int(n) or n >= 100000 else -(int(n) - 1)
    return _with_type(p, table, tree, lambda v, k, w: F.sum(zeroed(v, k)).over(w.rowsBetween(back, 0)), added, 0)


@function("TIME_SINCE", 1, pack="counts")
def time_since(p, table, tree):
    def make(v, k, w):
        begun = F.min(F.when(col("__has") & (col(table.date) >= as_block(v, k, p.block)), col("__rn"))).over(w.rowsBetween(FIRST, 0))
        return F.coalesce(col("__rn") - begun, F.lit(-9999)).cast("long")

    return sequence(p, table, tree, make, LONG, 0)


@function("TIME_SINCE_SEEN", 1, pack="counts")
def time_since_seen(p, table, tree):
    return sequence(p, table, tree, lambda v, k, w: (col("__rn") - F.last(F.when(truthy(v, k), col("__rn")), True).over(w.rowsBetween(FIRST, 0))).cast("long"), LONG, -999)


@function("FUTURE_UNTIL", 1, pack="future")
def future_until(p, table, tree):
    return sequence(p, table, tree, lambda v, k, w: (col("__rn") - F.last(F.when(v.isNotNull(), col("__rn")), True).over(w.rowsBetween(FIRST, 0))).cast("long"), LONG, -999)


@function("FUTURE_WITHIN", 2, pack="future")
def future_within(p, table, tree):
    n = int(number(tree.args[1]))
    return sequence(p, table, tree, lambda v, k, w: F.coalesce(F.max(truthy(v, k)).over(w.rangeBetween(1, n)), F.lit(False)) if n > 0 else F.lit(False), BOOL, False)


def trailing(w, n: float):
    return w.rangeBetween(-(int(n) - 1), 0)


@function("WINDOW_SUM", 2, pack="window")
def window_sum(p, table, tree):
    n = number(tree.args[1])
    return _with_type(p, table, tree, lambda v, k, w: F.sum(v).over(trailing(w, n)), added, 0)


@function("WINDOW_FIRST", 2, pack="window")
def window_first(p, table, tree):
    n = number(tree.args[1])
    return sequence(p, table, tree, lambda v, k, w: F.first(seen(v, k), True).over(trailing(w, n)))


@function("WINDOW_LAST", 2, pack="window")
def window_last(p, table, tree):
    n = number(tree.args[1])
    return sequence(p, table, tree, lambda v, k, w: F.last(seen(v, k), True).over(trailing(w, n)))


@function("WINDOW_COUNT_NOTNA", 2, pack="window")
def window_count(p, table, tree):
    n = number(tree.args[1])
    return sequence(p, table, tree, lambda v, k, w: F.count(seen(v, k)).over(trailing(w, n)), LONG, 0)


@function("STREND", 1, pack="trend")
def strend(p, table, tree):
    def make(v, k, w):
        now = zeroed(v, k).cast("double")
        return now - F.coalesce(F.sum(now).over(w.rowsBetween(-5, -1)), F.lit(0.0)) / F.lit(5)

    return sequence(p, table, tree, make, DOUBLE, -99999)


@function("TREND_DIFF", 2, pack="trend")
def trend_diff(p, table, tree):
    d = int(number(tree.args[1]))

    def make(v, k, w):
        return zeroed(v, k) - F.coalesce(F.sum(v).over(w.rangeBetween(-d, -d)), F.lit(0).cast(added(k)))

    return _with_type(p, table, tree, make, added, 0)


@function("CP_CHANGED", 1, pack="compare")
def cp_changed(p, table, tree):
    def make(v, k, w):
        before = F.last(seen(v, k), True).over(w.rowsBetween(FIRST, -1))
        return truthy(v, k) & ~v.eqNullSafe(before)

    return sequence(p, table, tree, make, BOOL, False)


@function("FIRST", 1, pack="compare")
def first(p, table, tree):
    return sequence(p, table, tree, lambda v, k, w: F.first(seen(v, k), True).over(w.rowsBetween(FIRST, 0)))


@function("LAST", 1, pack="compare")
def last(p, table, tree):
    return sequence(p, table, tree, lambda v, k, w: F.last(seen(v, k), True).over(w.rowsBetween(FIRST, 0)))


@function("LAST_BEFORE", 1, pack="compare")
def last_before(p, table, tree):
    return sequence(p, table, tree, lambda v, k, w: F.last(seen(v, k), True).over(w.rowsBetween(FIRST, -1)))
