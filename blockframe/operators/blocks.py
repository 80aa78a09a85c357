"""Blocks of one entity as bits: 64 of them in a word, so that no plan holds a row or a key for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.model import col

WORD = 64


def word(block: str) -> Column:
    """The number of the word that a block lies in."""
    return F.shiftright(col(block), 6)


def bit(block: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), col(block).bitwiseAND(F.lit(WORD - 1)))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by keys in as many partitions as a shuffle has. Spark joins small partitions before it knows that blocks blow them up; these it leaves alone. Costs nothing where rows lie so already."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *map(col, keys))


def packed_blocks(df: DataFrame, key: str, block: str, between: tuple[int, int]) -> DataFrame:
    """A row for each key with __bits, the words of its blocks from the first to the last of `between`. All rows lie in that range."""
    words = range(between[0] >> 6, (between[1] >> 6) + 1)
    bits = (F.coalesce(F.bit_or(F.when(word(block) == w, bit(block))), F.lit(0).cast("long")).alias(f"__bits{w - words[0]}") for w in words)
    return dealt(df, key).groupBy(col(key)).agg(*bits).select(col(key), F.array(*(F.col(f"__bits{i}") for i in range(len(words)))).alias("__bits"))


def has_block(block: str, between: tuple[int, int]) -> Column:
    """Whether a block's bit is set in __bits."""
    return F.element_at("__bits", word(block) - F.lit((between[0] >> 6) - 1)).bitwiseAND(bit(block)) != 0


def distinct_blocks(df: DataFrame, key: str, block: str, between: tuple[int, int]) -> DataFrame:
    """Distinct rows of key and block. What is grouped is a key, not a block of it."""
    every = F.explode(F.sequence(*map(F.lit, between))).alias(block)
    return packed_blocks(df, key, block, between).select(col(key), "__bits", every).where(has_block(block, between)).select(col(key), col(block))


def repeats(df: DataFrame, keys: list[str], block: str | None) -> DataFrame:
    """One row with m.n, how many rows are too many in the group that has most of them, and m.k, that group's keys."""
    text = F.concat_ws(", ", *(col(k).cast("string") for k in keys)).alias("k")
    groups = df.groupBy(*(col(k) for k in keys), *([word(block).alias("__word")] if block else []))
    if block:
        counts = groups.agg(F.count(F.lit(1)).alias("n"), F.bit_or(bit(block)).alias("__bits")).withColumn("n", F.col("n") - F.bit_count("__bits"))
    else:
        counts = groups.agg((F.count(F.lit(1)) - 1).alias("n"))
    return counts.agg(F.max(F.struct("n", text)).alias("m"))
