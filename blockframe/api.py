"""The one entry point: tables, pointers and expressions in, one wide DataFrame out."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import functions  # noqa: F401  registers all functions
from .operators.blocks import distinct_blocks
from .plans import calendar, lang
from .plans.model import Edge, Graph, PlanError, Table, col, merged
from .plans.planner import Planner

MOCK = 54321


def assemble(
    features: list[str],
    dataframes: dict[str, DataFrame],
    table_configs: dict[str, dict],
    output_config: dict[str, object],
    block_type: str = "month",
    *,
    mock: bool = False,
    now: object = None,
    genders: DataFrame | None = None,
    check_keys: bool | None = None,
    check_blocks: bool = False,
    display: bool = True,
) -> DataFrame:
    """One row per entity and time block, one column per feature, named by its text without white space.

    table_configs: {table: {'key': column or columns, 'pointers': {column: 'table.column'} or None,
    'date_key': column of a live table, 'order_by': columns, for LATEST}}.
    output_config: {entity: 'table.column', date_field: [Sunday, Sunday]}.
    The result is lazy; only ROUND_CLUSTER, ACC and TSINCESEEN read something when they are planned.
    By default a query fails when it runs if keys repeat in a table that it points to or whose own
    rows it takes; check_keys=True runs a job per table that raises at once, and False looks at no keys
    (rows that repeat are then joined as they are, and in sequences the largest values of a block count).
    check_blocks runs a job that warns of the range's blocks that the live table lacks.
    With display, dates are texts (a month, or a week's Sunday) and __dcount__ repeats them;
    else the date field holds the blocks' numbers."""
    if block_type not in calendar.BLOCKS:
        raise ValueError(f"block_type is one of {', '.join(calendar.BLOCKS)}")
    graph = Graph()
    for name, config in table_configs.items():
        if name not in dataframes:
            warnings.warn(f"no dataframe for table {name}; it is left out", stacklevel=2)
            continue
        if name != name.lower():
            raise PlanError(f"table names are lower case: {name}")
        graph.tables[name] = _table(name, dataframes[name], config, block_type)
        if check_keys:
            _check(graph.tables[name])
    for name in graph.tables:
        for column, target in (table_configs[name].get("pointers") or {}).items():
            graph.edges.append(_edge(name, column, target))
    trees = lang.parse_all(features)
    output = _scaffold(graph, output_config, block_type)
    if check_blocks:
        _warn_of_missing(output, next(v for v in output_config.values() if isinstance(v, (list, tuple))), block_type)
    names = [t.name for t in trees]
    taken = set(names) & {*output.key, output.date, "__dcount__"}
    if taken:
        raise PlanError(f"features are named as the result's own columns: {', '.join(sorted(taken))}")
    if mock:
        df = output.df.select(*(F.lit(MOCK).alias(n) for n in names), col(output.date), *(col(k) for k in output.key))
        return _shown(df, output, block_type) if display else df
    planner = Planner(graph, block_type, output, now, genders, check_keys is None)
    rows = [planner.row(output, planner.value(output, t)) for t in trees]
    df = planner.built(output, merged(*(r.joins for r in rows)))
    df = df.select(*(r.make().alias(n) for r, n in zip(rows, names)), col(output.date), *(col(k) for k in output.key))
    return _shown(df, output, block_type) if display else df


def _table(name: str, df: DataFrame, config: dict, block: str) -> Table:
    key = config["key"]
    key = [key] if isinstance(key, str) else list(key)
    date = config.get("date_key")
    missing = [c for c in [*key, *([date] if date else []), *config.get("order_by", ())] if c not in df.columns]
    if missing:
        raise PlanError(f"table {name} has no column {', '.join(missing)}")
    if date:
        df = df.withColumn(date, calendar.as_block(col(date), df.schema[date].dataType, block))
    return Table(name, df, key, date, list(config.get("order_by", ())))


def _edge(table: str, column: str, target: str) -> Edge:
    if not re.fullmatch(r"\w+\.\w+", target):
        raise PlanError(f"a pointer is 'table.column', not {target!r}")
    return Edge(table, column, *target.split("."))


def _check(table: Table) -> None:
    keys = [*table.key, *([table.date] if table.date else [])]
    if table.df.groupBy(*(col(k) for k in keys)).count().where("count > 1").limit(1).count():
        raise PlanError(f"keys of table {table.name} repeat: {', '.join(keys)}")


def _scaffold(graph: Graph, config: dict[str, object], block: str) -> Table:
    """The result's rows: distinct entities and blocks of the live table that the output points to, within the range."""
    dates = {k: v for k, v in config.items() if isinstance(v, (list, tuple))}
    pointers = {k: v for k, v in config.items() if isinstance(v, str)}
    if len(dates) != 1 or len(pointers) != 1 or len(config) != 2:
        raise PlanError("an output has one date field with a range and one pointer")
    ((field, between),) = dates.items()
    ((entity, target),) = pointers.items()
    edge = _edge("output", entity, target)
    table = graph.table(edge.to_table)
    if not table.date:
        raise PlanError(f"{table.name} has no date_key, so its rows have no blocks")
    blocks = calendar.blocks_between(between, block)
    df = table.df.select(col(edge.to_column).alias(entity), col(table.date).alias(field))
    between = (blocks[0], blocks[-1])
    df = distinct_blocks(df.where(col(entity).isNotNull() & col(field).between(*between)), entity, field, between)
    graph.edges.append(edge)
    output = graph.tables["output"] = Table("output", df, [entity], field, between=between)
    return output


def _warn_of_missing(output: Table, between: list | tuple, block: str) -> None:
    wanted = calendar.blocks_between(between, block)
    have = {r[0] for r in output.df.select(col(output.date)).distinct().collect()}  # at most the range's blocks
    missing = [b for b in wanted if b not in have]
    if missing:
        warnings.warn(f"{len(missing)} of {len(wanted)} blocks are not in the live table: {', '.join(map(str, missing[:10]))}{' ...' if len(missing) > 10 else ''}", stacklevel=3)


def _shown(df: DataFrame, output: Table, block: str) -> DataFrame:
    return df.withColumn(output.date, calendar.shown(col(output.date), block)).withColumn("__dcount__", col(output.date))
