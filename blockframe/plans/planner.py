"""From syntax trees to plans.

A value is a Row (a column of the current table, with the joins it needs) or a Frame (sparse
rows by pivots). Aggregates of one table with one list of groups share an aggregation;
sequence functions over one source share a grid and its windows; values of one source share a
join; columns behind one pointer share a join. So the plan grows with the kinds of features,
not with their number."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.blocks import dealt, repeats
from . import lang
from .model import Derived, Edge, Frame, Graph, PlanError, Row, Source, Table, col, filled, fresh, merged


@dataclass
class Function:
    """A registered function: least and most arguments, whether groups are needed ('yes'), allowed ('may') or not ('no'), and its planning."""

    name: str
    plan: Callable
    least: int
    most: int
    groups: str = "no"
    pack: str = ""


REGISTRY: dict[str, Function] = {}


def function(name: str, args: int | tuple[int, int], groups: str = "no", pack: str = ""):
    """Registers a planning function under a name that no other pack has."""

    def add(plan: Callable) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        least, most = (args, args) if isinstance(args, int) else args
        REGISTRY[name] = Function(name, plan, least, most, groups, pack or plan.__module__.rsplit(".", 1)[-1])
        return plan

    return add


class Aggregation(Source):
    """One grouping of a table, and all aggregates asked of it."""

    def __init__(self, planner: Planner, table: Table, groups: list[Row]):
        super().__init__([g.name for g in groups])
        self.planner, self.table, self.groups = planner, table, groups
        self.inputs: dict[str, tuple[str, Row]] = {}
        self.outputs: dict[str, tuple[str, Callable[[], Column]]] = {}

    def input(self, row: Row) -> str:
        return self.inputs.setdefault(row.name, (fresh("a"), row))[0]

    def output(self, key: str, make: Callable[[], Column]) -> str:
        return self.outputs.setdefault(key, (fresh(), make))[0]

    def build(self) -> DataFrame:
        rows = [*self.groups, *(r for _, r in self.inputs.values())]
        df = self.planner.built(self.table, merged(*(r.joins for r in rows)))
        df = df.select(*(g.make().alias(g.name) for g in self.groups), *(r.make().alias(c) for c, r in self.inputs.values()), *(col(c).alias(f"__order_{c}") for c in self.table.order))
        for g in self.groups:
            df = df.where(col(g.name).isNotNull())
        return df.groupBy(*(col(g.name) for g in self.groups)).agg(*(make().alias(name) for name, make in self.outputs.values()))


def once(df: DataFrame, keys: list[str], date: str | None, table: str) -> DataFrame:
    """Rows without null keys; the query fails where a key (and its date) repeats. Keys alone are counted, in a plan of their own: the rows' plan stays as it is but for a filter."""
    for k in [*keys, *([date] if date else [])]:
        df = df.where(col(k).isNotNull())
    most = repeats(df, keys, date).scalar()
    repeated = F.raise_error(F.concat(F.lit(f"keys of table {table} repeat: "), most["k"]))
    return df.where(F.when(most["n"] > 0, repeated.cast("boolean")).otherwise(F.lit(True)))


class Rows(Source):
    """The current table's own rows as a sparse source: values by the table's key and date."""

    def __init__(self, planner: Planner, table: Table):
        super().__init__([*table.key, *([table.date] if table.date else [])])
        self.planner, self.table = planner, table
        self.once = table.name if planner.unique else None
        self.blown = table.date is not None
        #: whether these are the result's rows, none of them twice
        self.own = table is planner.output and planner.unique
        self.values: dict[str, tuple[str, Row]] = {}

    def value(self, row: Row) -> str:
        return self.values.setdefault(row.name, (fresh(), row))[0]

    def build(self) -> DataFrame:
        rows = self.values.values()
        df = self.planner.built(self.table, merged(*(r.joins for _, r in rows)))
        return df.select(*(col(p) for p in self.pivots), *(r.make().alias(n) for n, r in rows))

    def df(self) -> DataFrame:
        return once(self.rows(), self.table.key, self.table.date, self.once) if self.once else self.rows()


@dataclass
class Planner:
    graph: Graph
    block: str
    output: Table | None = None
    #: what CMONTHSINCE counts from; the time of planning if not given
    now: object = None
    #: name -> gender, a DataFrame of (name, gender), for PEOPLE_GENDER
    genders: DataFrame | None = None
    #: whether a query fails that meets a key twice
    unique: bool = True
    sources: dict[tuple, Source] = field(default_factory=dict)
    memo: dict[tuple[str, str], Row | Frame] = field(default_factory=dict)
    lookups: dict[int, DataFrame] = field(default_factory=dict)

    # --- evaluation ------------------------------------------------------------------

    def value(self, table: Table, tree: object) -> Row | Frame:
        """The fresh value of a tree in a table; equal trees give one value."""
        key = (table.name, tree.name)
        if key not in self.memo:
            self.memo[key] = self._value(table, tree)
        return self.memo[key]

    def _value(self, table: Table, tree: object) -> Row | Frame:
        if isinstance(tree, lang.Literal):
            raise PlanError(f"{tree.name} is a literal where a column is needed")
        if isinstance(tree, lang.Column):
            if tree.rest is None:
                kind = table.type_of(tree.column)
                value = (lambda: F.nanvl(col(tree.column), F.lit(None).cast(kind))) if isinstance(kind, (T.DoubleType, T.FloatType)) else (lambda: col(tree.column))
                return Row(value, kind, tree.name, path=tree.name)
            return self.pointed(table, tree)
        if isinstance(tree, lang.Root):
            return self.rooted(table, tree)
        f = REGISTRY.get(tree.function)
        if f is None:
            raise PlanError(f"there is no function {tree.function}")
        if not f.least <= len(tree.args) <= f.most:
            raise PlanError(f"{f.name} takes {f.least}{'' if f.least == f.most else f' to {f.most}'} arguments, not {len(tree.args)}")
        if tree.groups and f.groups == "no":
            raise PlanError(f"{f.name} takes no groups")
        if not tree.groups and f.groups == "yes":
            raise PlanError(f"{f.name} needs groups")
        return f.plan(self, table, tree)

    def pointed(self, table: Table, tree: lang.Column) -> Row:
        """A value of the row that a pointer of the current table names: one join for each pointer, by key and, between dated tables, date."""
        edge = self.graph.edge(table.name, tree.column)
        if edge is None:
            raise PlanError(f"{table.name}.{tree.column} is no pointer")
        target = self.graph.table(edge.to_table)
        if target.date and not table.date:
            raise PlanError(f"{table.name} has no date, so {tree.column} would point to every row of {target.name} with that key")
        row = self.row(target, self.value(target, tree.rest))
        name = fresh("p")
        path = tree.name if row.path is not None else None
        return Row(lambda: col(name), row.type, tree.name, {("pointer", table.name, tree.column): {name: row}}, path)

    def rooted(self, table: Table, tree: lang.Root) -> Frame:
        """A value of another table, its pivots named as columns of the current one."""
        other = self.graph.table(tree.table)
        frame = self.frame(other, self.value(other, tree.path))
        have = set(table.df.columns)
        pivots = frame.source.pivots
        pairs = {b: a for a, b in tree.pairs} if any(p not in have for p in pivots) else {}
        return replace(frame, name=tree.name, table=table.name, on={p: p if p in have else pairs.get(p) or self.translated(table, other, p) for p in pivots})

    def translated(self, table: Table, other: Table, pivot: str) -> str:
        leaf = self.graph.leaf(other.name, pivot)
        if leaf[0] == table.name and leaf[1] in table.df.columns:
            return leaf[1]
        edges = [e for e in self.graph.edges if e.table == table.name and (e.to_table, e.to_column) == leaf]
        if len(edges) > 1:
            raise PlanError(f"{len(edges)} pointers of {table.name} lead to {leaf[0]}.{leaf[1]}; say which by {{column={pivot}}}")
        if edges:
            return edges[0].column
        if pivot.startswith("DATE") and self.output is not None and table is self.output:
            return table.date
        raise PlanError(f"{table.name} has nothing that {pivot} of {other.name} could be; name it by {{column={pivot}}}")

    # --- conversions -----------------------------------------------------------------

    def row(self, table: Table, value: Row | Frame) -> Row:
        """A value on the current table's rows: frames are joined on their pivots and filled."""
        if isinstance(value, Row):
            return value
        missing = [c for _, c in value.joined_on() if c not in table.df.columns]
        if missing:
            # pivots that are expressions of the current table, such as another feature's groups
            rows = {c: self.row(table, self.value(table, lang.parse(c))) for c in missing}
        else:
            rows = {}
        name = fresh("f")
        joins = {("frame", value.source.id, tuple(value.joined_on())): {name: (value.source, value.value)}}
        for c, r in rows.items():
            joins = merged(joins, r.joins, {("column", c): {c: r}})
        return Row(lambda: filled(col(name), value.fill, value.type), value.type, value.name, joins)

    def frame(self, table: Table, value: Row | Frame) -> Frame:
        """A value as sparse rows: a table's column by the table's key."""
        if isinstance(value, Frame):
            return value
        source = self.source(("rows", table.name), lambda: Rows(self, table))
        return Frame(source, source.value(value), value.type, value.name, table=table.name)

    def source(self, key: tuple, make: Callable[[], Source]) -> Source:
        if key not in self.sources:
            self.sources[key] = make()
        return self.sources[key]

    def aggregation(self, table: Table, groups: list[Row]) -> Aggregation:
        return self.source(("groups", table.name, tuple(g.name for g in groups)), lambda: Aggregation(self, table, groups))

    def mapped(self, table: Table, tree: lang.Call, f: Callable[[Column, T.DataType], Column], kind: T.DataType | None, fill: object, arg: int = 0) -> Row | Frame:
        """A function of single values: nulls stay out of it and get the fill."""
        value = self.value(table, tree.args[arg])
        out = kind or value.type
        if isinstance(value, Row):
            return Row(lambda: filled(F.when(value.make().isNotNull(), f(value.make(), value.type)), fill, out), out, tree.name, value.joins)
        name = value.source.then(tree.name, lambda: F.when(col(value.value).isNotNull(), f(col(value.value), value.type)))
        return replace(value, value=name, type=out, name=tree.name, fill=fill, sparse=True)

    # --- building --------------------------------------------------------------------

    def built(self, table: Table, joins: dict[tuple, dict[str, object]]) -> DataFrame:
        """The table's rows with all joins, each once."""
        own = ("pointer", table.name, table.key[0])
        # the result's rows are those of the live table that its entity points to: where none repeats, they need no join to themselves
        alike = table is self.output and self.unique and own in joins
        df = self._own(table, joins[own]) if alike else table.df
        if alike:
            joins = {k: v for k, v in joins.items() if k != own}
        spread = False
        for key in sorted(joins, key=lambda k: ("pointer", "column", "lookup", "frame").index(k[0])):
            values = joins[key]
            if key[0] == "pointer":
                edge = self.graph.edge(key[1], key[2])
                df = self._point(df, table, edge, values)
            elif key[0] == "lookup":
                other, own = self.lookups[key[1]], fresh("k")
                (out,) = values
                df = df.join(other.toDF(own, out), col(key[2]) == col(own), "left").drop(own)
            elif key[0] == "column":
                for name, row in values.items():
                    df = df.withColumn(name, row.make())
            else:
                on = [c for _, c in key[2]]
                if table is self.output and table.date in on and not spread:
                    df, spread = dealt(df, *on), True
                df = self._attach(df, key[2], values)
        return df

    def _target(self, edge: Edge, values: dict[str, Row]) -> tuple[DataFrame, str, str]:
        """The rows that a pointer leads to, and their key and date."""
        target = self.graph.table(edge.to_table)
        key, date = fresh("k"), fresh("k")
        right = self.built(target, merged(*(r.joins for r in values.values())))
        right = right.select(col(edge.to_column).alias(key), *([col(target.date).alias(date)] if target.date else []), *(r.make().alias(n) for n, r in values.items()))
        if self.unique:
            right = once(right, [key], date if target.date else None, target.name)
        return right, key, date

    def _own(self, table: Table, values: dict[str, Row]) -> DataFrame:
        """The result's rows with values of the live table that they come from."""
        right, key, date = self._target(self.graph.edge(table.name, table.key[0]), values)
        return right.where(col(date).between(*table.between)).select(col(key).alias(table.key[0]), col(date).alias(table.date), *(col(n) for n in values))

    def _point(self, df: DataFrame, table: Table, edge: Edge, values: dict[str, Row]) -> DataFrame:
        right, key, date = self._target(edge, values)
        on = col(edge.column) == col(key)
        if self.graph.table(edge.to_table).date:
            # a live table may be blown up by blocks, which Spark's estimates do not see
            return df.join(right.hint("merge"), on & (col(table.date) == col(date)), "left").drop(key, date)
        return df.join(right, on, "left").drop(key, date)

    def _attach(self, df: DataFrame, on: tuple[tuple[str, str], ...], values: dict[str, tuple[Source, str]]) -> DataFrame:
        source = next(iter(values.values()))[0]
        keys = {p: fresh("k") for p, _ in on}
        right = source.df().select(*(col(p).alias(k) for p, k in keys.items()), *(col(v).alias(n) for n, (_, v) in values.items()))
        if not on:
            return df.crossJoin(F.broadcast(right))  # a single row
        condition = None
        for p, c in on:
            same = col(c) == col(keys[p])
            condition = same if condition is None else condition & same
        return df.join(right.hint("merge") if source.blown else right, condition, "left").drop(*keys.values())


def derived(planner: Planner, frame: Frame, tree: lang.Call, make: Callable[[DataFrame, list[str], str], DataFrame], kind: T.DataType, fill: object, blown: bool = False) -> Frame:
    """A frame of its own plan: make gets rows of keys and value, the pivots renamed to the current table's columns, and gives the same columns."""
    names = [c for _, c in frame.joined_on()]

    def build() -> DataFrame:
        df = frame.source.df().select(*(col(p).alias(c) for p, c in frame.joined_on()), col(frame.value).alias("__value"))
        return make(df.where(col("__value").isNotNull()) if frame.sparse else df, names, "__value")

    return Frame(Derived(names, build, blown or frame.source.blown), "__value", kind, tree.name, fill, table=frame.table)
