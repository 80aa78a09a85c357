"""Tables, pointers between them, and values on their way to the result."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ids = itertools.count()


class PlanError(ValueError):
    """An expression that these tables cannot answer."""


def fresh(prefix: str = "v") -> str:
    return f"__{prefix}{next(_ids)}"


def col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Edge:
    table: str
    column: str
    to_table: str
    to_column: str


@dataclass
class Table:
    """A named DataFrame with a key, and for a live table its block column."""

    name: str
    df: DataFrame
    key: list[str]
    date: str | None = None
    order: list[str] = field(default_factory=list)
    #: the result's first and last block
    between: tuple[int, int] | None = None

    def type_of(self, column: str) -> T.DataType:
        try:
            return self.df.schema[column].dataType
        except KeyError:
            raise PlanError(f"table {self.name} has no column {column}") from None


class Graph:
    def __init__(self):
        self.tables: dict[str, Table] = {}
        self.edges: list[Edge] = []

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise PlanError(f"there is no table {name}")
        return self.tables[name]

    def edge(self, table: str, column: str) -> Edge | None:
        return next((e for e in self.edges if e.table == table and e.column == column), None)

    def leaf(self, table: str, path: str) -> tuple[str, str]:
        """The table and column that a path of pointers ends in."""
        for step in path.split("."):
            edge = self.edge(table, step)
            if edge is None:
                return table, step
            table, last = edge.to_table, edge.to_column
        return table, last


class Source:
    """A plan with pivots that several values share, so that each is computed and joined once.

    Values are asked for before anything is built; build() then makes one DataFrame of all."""

    def __init__(self, pivots: list[str]):
        self.pivots, self.id, self._df = pivots, next(_ids), None
        #: the table whose rows these are, if a query is to fail where their pivots repeat
        self.once: str | None = None
        #: whether rows are blown up by blocks: Spark's estimates do not see it and would broadcast them
        self.blown = self.own = False
        self.later: dict[str, tuple[str, Callable[[], Column]]] = {}

    def then(self, key: str, make: Callable[[], Column]) -> str:
        """A column computed from other values of this source; one for each key."""
        if key not in self.later:
            self.later[key] = (fresh(), make)
        return self.later[key][0]

    def build(self) -> DataFrame:
        raise NotImplementedError

    def df(self) -> DataFrame:
        """Rows by pivots, each pivots' once."""
        return self.rows()

    def rows(self) -> DataFrame:
        """The same, before anyone has looked whether pivots repeat."""
        if self._df is None:
            out = self.build()
            for name, make in self.later.values():
                out = out.withColumn(name, make())
            self._df = out
        return self._df


class Derived(Source):
    """A source of one value, by a function of another source's DataFrame."""

    def __init__(self, pivots: list[str], make: Callable[[], DataFrame], blown: bool = False):
        super().__init__(pivots)
        self.make, self.blown = make, blown

    def build(self) -> DataFrame:
        return self.make()


@dataclass
class Frame:
    """A sparse value: rows of a source, by pivots. `on` names the current table's column for each pivot."""

    source: Source
    value: str
    type: T.DataType
    name: str
    fill: object = None
    on: dict[str, str] = field(default_factory=dict)
    table: str = ""
    #: a null value stands for a missing row
    sparse: bool = False

    def joined_on(self) -> list[tuple[str, str]]:
        return [(p, self.on.get(p, p)) for p in self.source.pivots]


@dataclass
class Row:
    """A dense value: a column of the current table's rows, with the joins that it needs."""

    make: Callable[[], Column]
    type: T.DataType
    name: str
    joins: dict[tuple, dict[str, object]] = field(default_factory=dict)
    #: the path of pointers that it follows, when it is one
    path: str | None = None


def merged(*joins: dict[tuple, dict[str, object]]) -> dict[tuple, dict[str, object]]:
    out: dict[tuple, dict[str, object]] = {}
    for j in joins:
        for key, values in j.items():
            out.setdefault(key, {}).update(values)
    return out


def typed(fill: object, kind: T.DataType) -> Column | None:
    """A fill of the value's own type: 0, '0' or False for 0."""
    if fill is None:
        return None
    if isinstance(kind, T.StringType):
        return F.lit(fill if isinstance(fill, str) else str(fill))
    if isinstance(kind, T.BooleanType):
        return F.lit(bool(fill))
    if isinstance(kind, T.NumericType):
        return F.lit(fill).cast(kind)
    return None


def filled(value: Column, fill: object, kind: T.DataType) -> Column:
    by = typed(fill, kind)
    return value if by is None else F.coalesce(value, by)


def truthy(value: Column, kind: T.DataType) -> Column:
    """Not null, zero, empty or false."""
    if isinstance(kind, T.StringType):
        seen = value != ""
    elif isinstance(kind, T.BooleanType):
        seen = value
    elif isinstance(kind, T.NumericType):
        seen = value != 0
    else:
        seen = value.isNotNull()
    return F.coalesce(seen, F.lit(False))
