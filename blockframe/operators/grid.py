"""A dense grid of time blocks for each entity, with sequence expressions over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.model import Source, Table, col, fresh
from .blocks import dealt, has_block, packed_blocks


def by_block(block: str, value: str, kind: T.DataType, once: str | None = None) -> Column:
    """An aggregate: a map from blocks to values. If a block repeats the query fails, with `once` for the table's name; without it the last in the values' order counts. (Maps have no order, so theirs must be single.)"""
    entries = F.collect_list(F.struct(F.col(block), F.col(value)))
    if "map<" in kind.simpleString():
        return F.map_from_entries(entries)
    ordered = F.sort_array(entries)
    last = F.filter(ordered, lambda x, i: ~x[block].eqNullSafe(F.get(ordered, i + 1)[block]))
    if once:
        last = F.when(F.size(last) == F.size(ordered), last).otherwise(F.raise_error(F.lit(f"keys of table {once} repeat")))
    return F.map_from_entries(last)


class Grid(Source):
    """Rows (entity, block) for every entity of a child source and every block of the scaffold.

    The child's rows of an entity become one map from block to values, of at most as many entries
    as there are blocks; so one shuffle by entity serves the grid and all windows over it."""

    def __init__(self, child: Source, on: list[tuple[str, str]], table: Table):
        date = table.date
        self.keys = [(p, c) for p, c in on if c != date]
        self.date_pivot = next(p for p, c in on if c == date)
        super().__init__([*(c for _, c in self.keys), date])
        self.child, self.date, self.table, self.blown = child, date, table, True
        self.inputs: dict[str, str] = {}
        self.present: dict[str, str] = {}
        self.outputs: dict[str, tuple[str, Callable[[Window], Column]]] = {}

    def input(self, value: str) -> str:
        return self.inputs.setdefault(value, fresh("i"))

    def output(self, key: str, make: Callable[[Window], Column], sparse_input: str | None = None) -> str:
        if key not in self.outputs:
            self.outputs[key] = (fresh(), make, sparse_input)
        return self.outputs[key][0]

    def packed(self) -> DataFrame:
        """Keys, blocks, __has and inputs from maps of the child's rows."""
        keys, date = [c for _, c in self.keys], self.date
        cell = F.struct(*(col(v).alias(n) for v, n in self.inputs.items()))
        child = self.child.rows().where(col(self.date_pivot).isNotNull()).select(*(col(p).alias(c) for p, c in self.keys), col(self.date_pivot).cast("int").alias("__t"), cell.alias("__cell"))
        packed = (dealt(child, *keys) if keys else child).groupBy(*(col(c) for c in keys)).agg(by_block("__t", "__cell", child.schema["__cell"].dataType, self.child.once).alias("__cells"))
        rows = packed.crossJoin(F.broadcast(self.blocks())).select(*(col(c) for c in keys), "__cells", F.explode("__blocks").alias(date))
        rows = rows.select(*(col(c) for c in keys), col(date), F.try_element_at("__cells", col(date)).alias("__cell"))
        return rows.select(*(col(c) for c in keys), col(date), col("__cell").isNotNull().alias("__has"), *(F.col(f"__cell.{n}").alias(n) for n in self.inputs.values()))

    def completed(self) -> DataFrame:
        """The same of the result's own rows: they stay as they are, and those of blocks that an entity lacks are added."""
        (key,), date = (c for _, c in self.keys), self.date
        rows = self.child.rows().select(col(key), col(date), F.lit(True).alias("__has"), *(col(v).alias(n) for v, n in self.inputs.items()))
        every = packed_blocks(self.table.df, key, date, self.table.between).crossJoin(F.broadcast(self.blocks()))
        missing = every.select(col(key), "__bits", F.explode("__blocks").alias(date)).where(~has_block(date, self.table.between))
        missing = missing.select(col(key), col(date), F.lit(False).alias("__has"), *(F.lit(None).cast(rows.schema[n].dataType).alias(n) for n in self.inputs.values()))
        return dealt(rows, key).unionByName(missing)

    def blocks(self) -> DataFrame:
        """One row that holds the scaffold's blocks: as long as the requested range at most."""
        return self.table.df.agg(F.sort_array(F.collect_set(col(self.date))).alias("__blocks"))

    def build(self) -> DataFrame:
        keys, date = [c for _, c in self.keys], self.date
        rows = self.completed() if self.child.own else self.packed()
        w = (Window.partitionBy(*(col(c) for c in keys)) if keys else Window.partitionBy(F.lit(0))).orderBy(col(date))
        rows = rows.withColumn("__rn", F.row_number().over(w))
        out = []
        for name, make, sparse in self.outputs.values():
            value = make(w)
            if sparse is not None:
                # an entity without any such row is absent, and gets the fill
                whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
                value = F.when(F.max(col(sparse).isNotNull()).over(whole), value)
            out.append(value.alias(name))
        return rows.select(*(col(c) for c in self.pivots), *out)
