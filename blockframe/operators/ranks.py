"""Percentile ranks within dates, without a task that gets a whole date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import col


EDGES = 64


def percent_ranks(df: DataFrame, keys: list[str], date: str | None, value: str) -> DataFrame:
    """value becomes the average rank of its ties over the number of values, by date; nulls and negatives stay null.

    Ranks are those of distinct values. They are cut into cells by increasing functions of the value: fixed
    steps of about 0.1 percent, and within these EDGES quantiles of all distinct values, so that values near
    one level part as well. Totals per cell give each cell's start, and only the distinct values of one cell
    meet in one task. Where the quantiles lie changes no rank."""
    own = F.when(col(value) >= 0, col(value).cast("double") + F.lit(0.0))
    rows = df.withColumn(value, own).withColumn("__date", col(date) if date else F.lit(0))
    counts = rows.where(col(value).isNotNull()).groupBy("__date", col(value).alias("__v")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("cell", F.when(F.col("__v") > 0, F.floor(F.log(F.col("__v")) * 1000)).otherwise(F.lit(-(1 << 40))).cast("long"))
    edges = counts.agg(F.percentile_approx("__v", [k / EDGES for k in range(1, EDGES)], 1000).alias("__edges"))  # one row
    counts = counts.crossJoin(F.broadcast(edges)).withColumn("cell", F.struct("cell", F.size(F.filter("__edges", lambda e: e < F.col("__v"))).alias("part"))).drop("__edges")
    # cells of a date: some tens of thousands at most
    by_date = Window.partitionBy("__date").orderBy("cell")
    cells = counts.groupBy("__date", "cell").agg(F.sum("n").alias("m"))
    cells = cells.select("__date", "cell", (F.sum("m").over(by_date) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("__date")).alias("total"))
    within = Window.partitionBy("__date", "cell").orderBy("__v")
    ranked = counts.join(cells, ["__date", "cell"]).select("__date", "__v", ((F.col("before") + F.sum("n").over(within) - F.col("n") + (F.col("n") + 1) / 2) / F.col("total")).alias("__rank"))
    joined = rows.join(ranked, (rows["__date"] == ranked["__date"]) & (rows[value] == ranked["__v"]), "left")
    return joined.select(*(rows[f"`{c}`"] for c in keys), F.col("__rank").alias(value))
