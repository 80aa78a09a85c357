"""Aggregates by groups. Rows with a null group are left out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import Frame, PlanError, Table, col
from ..plans.planner import Planner, function


def _aggregate(p: Planner, table: Table, tree, make, kind=None, fill=None, sparse: bool = False) -> Frame:
    arg = p.row(table, p.value(table, tree.args[0]))
    groups = [p.row(table, p.value(table, g)) for g in tree.groups]
    source = p.aggregation(table, groups)
    name = source.input(arg)
    return Frame(source, source.output(tree.name, lambda: make(col(name), arg.type)), kind or arg.type, tree.name, fill, {g.name: g.name for g in groups}, table.name, sparse)


def exact_sum(v):
    """A sum of doubles that is the same in whatever order rows are added; null without values.

    A double is cut into signed whole numbers of 32 bits, in units of 2^32, 1, 2^-32, 2^-64 and 2^-96, and whole numbers
    add without rounding. Where a value is 2^62 or more, not finite, or has bits below 2^-96, the plain sum is taken."""
    x, step = v.cast("double"), 1 << 32
    unit = F.lit(float(step))
    fits = (F.abs(x) < F.lit(float(1 << 62))) & ((x * F.lit(float(1 << 96))) % F.lit(1.0) == 0)
    parts = (x / unit, x % unit, *((x * F.lit(float(1 << e))) % unit for e in (32, 64, 96)))
    sums = [F.coalesce(F.sum(F.when(fits, p.cast("long"))), F.lit(0).cast("long")) for p in parts]
    scale = [F.lit(float(step) ** e) for e in (1, 0, -1, -2, -3)]
    # a negative sum is worked out as a positive one, so that carries leave no digits that cancel
    sign = F.when(sum((s * k for s, k in zip(sums[1:], scale[1:])), sums[0] * scale[0]) < 0, -1).otherwise(1).cast("long")
    carry, digits = F.lit(0).cast("long"), []
    for s in sums[:0:-1]:
        total = s * sign + carry
        digits.append(total.bitwiseAND(F.lit(step - 1)))
        carry = F.shiftright(total, 32)
    whole = (sums[0] * sign + carry) * scale[0] + digits[3]
    exact = (whole + (digits[2] * scale[2] + (digits[1] * scale[3] + digits[0] * scale[4]))) * sign
    return F.when((F.count(x) > 0) & (F.count(x) == F.count(F.when(fits, 1))), exact).otherwise(F.sum(x))


@function("SUM", 1, "yes", "default")
def sum_(p, table, tree):
    return _aggregate(p, table, tree, lambda v, k: F.coalesce(exact_sum(v), F.lit(0.0)), T.DoubleType(), 0)


@function("COUNT", 1, "yes", "default")
def count(p, table, tree):
    return _aggregate(p, table, tree, lambda v, k: F.count(v), T.LongType(), 0)


@function("MEAN", 1, "yes", "default")
def mean(p, table, tree):
    return _aggregate(p, table, tree, lambda v, k: F.when(F.count(v) > 0, exact_sum(v) / F.count(v)), T.DoubleType())


@function("EXISTS", 1, "yes", "default")
def exists(p, table, tree):
    return _aggregate(p, table, tree, lambda v, k: (F.count(v) > 0).cast("long"), T.LongType())


@function("LATEST", 1, "yes", "default")
def latest(p, table, tree):
    """The first row's value in the table's declared order, null or not."""
    if not table.order:
        raise PlanError(f"LATEST needs an order_by for table {table.name}: rows have no order of their own")
    # the value inside a struct, so that a null first value is not passed over
    return _aggregate(p, table, tree, lambda v, k: F.min_by(F.struct(v.alias("v")), F.struct(*(col(f"__order_{c}") for c in table.order)))["v"], None, 0)


@function("COUNT_WHERE", 2, "yes", "default")
def count_where(p, table, tree):
    """Groups without such rows are absent."""
    value = literal(tree.args[1])
    return _aggregate(p, table, tree, lambda v, k: F.nullif(F.count(F.when(equals(v, k, value), 1)), F.lit(0)), T.LongType(), 0, sparse=True)


def literal(tree):
    from ..plans import lang

    if not isinstance(tree, lang.Literal):
        raise PlanError(f"{tree.name} is no literal")
    return tree.value


def number(tree) -> float:
    value = literal(tree)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise PlanError(f"{tree.name} is no number")
    return value


def equals(value, kind: T.DataType, other):
    """Equality with a literal of any type; a null equals nothing."""
    if other is None:
        return F.lit(False)
    if isinstance(kind, T.StringType):
        return value == F.lit(other if isinstance(other, str) else str(other))
    if isinstance(kind, T.BooleanType):
        return value == F.lit(other) if isinstance(other, bool) else F.lit(False)
    if isinstance(other, str):
        return value.cast("string") == F.lit(other)
    return value == F.lit(float(other))
