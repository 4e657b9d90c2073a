"""Seeded dev / test split by hash order, without a global sort.

Rows are ordered by md5(seed-id). The rank of a row is the count of rows in smaller hash prefixes (a small table) plus
its rank within its own prefix, so no task orders more than one prefix's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import DEV_FRACTION, SEED

#: Hex digits of a prefix: 4,096 prefixes.
PREFIX = 3


def hash_position(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed), key.cast("string")))


def dev_test_split(rows: DataFrame, key: str = "example_id", by: tuple[str, ...] = ("task",), fraction: float = DEV_FRACTION, seed: int = SEED) -> DataFrame:
    """rows with `pos` (their place in the permuted order, a sortable string), `position` (from 1) and `split`. The first
    half-even round(n * fraction) are dev."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    marked = rows.withColumn("pos", hash_position(F.col(key), seed)).withColumn("_p", F.substring("pos", 1, PREFIX))
    order = Window.partitionBy(*by).orderBy("_p")
    counts = marked.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    counts = counts.select(*by, "_p", (F.sum("_c").over(order) - F.col("_c")).alias("_below"), F.sum("_c").over(Window.partitionBy(*by)).alias("_n"))
    ranked = marked.join(counts, [*by, "_p"]).withColumn("position", F.col("_below") + F.row_number().over(Window.partitionBy(*by, "_p").orderBy("pos", key)))
    return ranked.withColumn("split", F.when(F.col("position") <= F.bround(F.col("_n") * fraction), "dev").otherwise("test")).drop("_p", "_below", "_n")
