"""Functions of a frame's own rows and dates, not of the result's grid."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.grid import by_block
from ..operators.ranks import percent_ranks
from ..plans.model import Derived, Frame, PlanError, col
from ..plans.planner import derived, function
from .aggregates import number
from .sequences import added


def dated(p, table, tree) -> tuple[Frame, str]:
    """The argument as a frame, and its date: the column that is the table's date or, in a table without one, a DATE group."""
    frame = p.frame(table, p.value(table, tree.args[0]))
    names = [c for _, c in frame.joined_on()]
    date = next((c for c in names if c == table.date), None) or next((c for c in names if c.startswith(("DATE(", "CMONTH("))), None)
    if date is None:
        raise PlanError(f"{tree.args[0].name} has no date")
    return frame, date


def output_dates(p) -> list[int]:
    """The result's blocks, at most as many as its range has; the driver needs them where a frame is bounded by their number."""
    if "dates" not in p.__dict__:
        p.__dict__["dates"] = sorted(r[0] for r in p.output.df.select(col(p.output.date)).distinct().collect())
    return p.__dict__["dates"]


@function("SHIFT", 2, "may", "default")
def shift(p, table, tree):
    frame, date = dated(p, table, tree)
    n = int(number(tree.args[1]))
    _same_groups(frame, tree)
    return derived(p, frame, tree, lambda df, keys, v: df.withColumn(date, (col(date) + F.lit(n)).cast("int")), frame.type, frame.fill)


def _same_groups(frame: Frame, tree) -> None:
    if tree.groups and {g.name for g in tree.groups} != {c for _, c in frame.joined_on()} and {g.name for g in tree.groups} != set(frame.source.pivots):
        raise PlanError(f"{tree.function}'s groups must be those of its argument")


@function("MINUSPREV", 1, "no", "default")
def minus_prev(p, table, tree):
    frame, date = dated(p, table, tree)

    def make(df, keys, v):
        kind = added(frame.type)
        now = df.select(*(col(c) for c in keys), F.coalesce(col(v).cast(kind), F.lit(0).cast(kind)).alias(v))
        before = now.select(*((col(c) + 1).cast("int").alias(c) if c == date else col(c) for c in keys), (-col(v)).alias(v))
        return now.unionByName(before).groupBy(*(col(c) for c in keys)).agg(F.sum(v).alias(v))

    return derived(p, frame, tree, make, added(frame.type), 0)


@function("ACC", 1, "no", "default")
def acc(p, table, tree):
    """Sums over as many blocks back as the result has, for blocks before its last; from that on the value alone."""
    frame, date = dated(p, table, tree)
    kind = added(frame.type)

    def make(df, keys, v):
        dates = output_dates(p)
        if not dates:
            return df.limit(0)
        n, last = len(dates), dates[-1]
        others = [c for c in keys if c != date]
        own = df.where(col(date).isNotNull()).select(*(col(c) for c in others), col(date).cast("int").alias("__t"), col(v).cast(kind).alias("__v"))
        cells = own.groupBy(*(col(c) for c in others)).agg(by_block("__t", "__v", kind).alias("__cells"))
        own = F.map_keys("__cells")
        start = F.array_min(own)
        # an entity's own blocks, and all from its first to the result's last
        every = F.array_union(own, F.when(start <= last, F.sequence(start, F.greatest(start, F.lit(last)))).otherwise(F.array().cast("array<int>")))
        rows = cells.select(*(col(c) for c in others), "__cells", F.explode(every).alias(date)).withColumn(v, F.try_element_at("__cells", col(date)))
        w = Window.partitionBy(*(col(c) for c in others)).orderBy(col(date)).rangeBetween(-n, 0)
        total = F.when(col(date) < last, F.coalesce(F.sum(col(v)).over(w), F.lit(0).cast(kind))).otherwise(F.coalesce(col(v), F.lit(0).cast(kind)))
        return rows.select(*(total.alias(v) if c == v else col(c) for c in [*others, date, v]))

    return derived(p, frame, tree, make, kind, 0, blown=True)


@function("RANK", 1, "no", "default")
def rank(p, table, tree):
    frame = p.frame(table, p.value(table, tree.args[0]))
    date = table.date if any(c == table.date for _, c in frame.joined_on()) else None
    return derived(p, frame, tree, lambda df, keys, v: percent_ranks(df, keys, date, v), T.DoubleType(), frame.fill)


@function("TSINCESEEN", 2, "yes", "default")
def time_since_last(p, table, tree):
    """Blocks since the largest value whose own block is not after the result's block at or before this one."""
    value, when = (p.row(table, p.value(table, a)) for a in tree.args)
    groups = [p.row(table, p.value(table, g)) for g in tree.groups]
    date = next((g.name for g in groups if g.name.startswith(("DATE(", "CMONTH(")) or g.name == table.date), None)
    if date is None:
        raise PlanError("TSINCESEEN needs a date among its groups")
    source = p.aggregation(table, [*groups, replace(when, name=f"__when_{when.name}")])
    name = source.input(value)
    top = source.output(tree.name, lambda: F.max(col(name)))
    others = [g.name for g in groups if g.name != date]

    def build():
        dates = output_dates(p)
        base = source.df().select(*(col(g.name) for g in groups), col(f"__when_{when.name}").alias("__when"), col(top).alias("__x"))
        # a value is first visible at the result's first block that is not before its own
        visible = F.array_min(F.filter(F.array(*map(F.lit, dates)).cast("array<int>"), lambda d: d >= F.col("__when")))
        values = base.select(*(col(c) for c in others), visible.alias(date), col("__x"), F.lit(False).alias("__grid")).where(col(date).isNotNull())
        # the grid: every entity by every block that any row has, a calendar's worth
        blocks = base.agg(F.collect_set(col(date)).alias("__blocks"))
        grid = base.select(*(col(c) for c in others)).distinct().crossJoin(F.broadcast(blocks)).select(*(col(c) for c in others), F.explode("__blocks").alias(date), F.lit(None).cast("int").alias("__x"), F.lit(True).alias("__grid"))
        w = Window.partitionBy(*(col(c) for c in others)).orderBy(col(date)).rangeBetween(Window.unboundedPreceding, 0)
        out = values.unionByName(grid).withColumn("__m", F.max("__x").over(w)).where("__grid")
        return out.select(*(col(c) for c in others), col(date), F.coalesce(col(date) - col("__m"), F.lit(-99999)).cast("long").alias("__value"))

    names = [*others, date]
    return Frame(Derived(names, build, True), "__value", T.LongType(), tree.name, -99999, {c: c for c in names}, table.name)
