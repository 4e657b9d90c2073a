"""Signals as rows: (task, example_id, signal, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import finite
from .registry import NAMES, signal_registry

NAN = float("nan")


def signal_map(values: dict[str, Column]) -> Column:
    """The map of all 26 signals; NaN where a value is missing. KeyError for a name not in the registry."""
    if unknown := values.keys() - set(NAMES):
        raise KeyError(sorted(unknown))
    missing = F.lit(NAN)
    return F.map_from_arrays(F.array(*[F.lit(n) for n in NAMES]), F.array(*[F.coalesce(values[n].cast("double"), missing) if n in values else missing for n in NAMES]))


def long_signals(records: DataFrame, column: str = "signals", keep: tuple[str, ...] = ("task", "example_id")) -> DataFrame:
    return records.select(*keep, F.explode(column).alias("signal", "value"))


def to_uncertainty(rows: DataFrame) -> DataFrame:
    """rows with `u`: the value, negated where it stands for confidence. The registry has 26 rows."""
    spec = F.broadcast(signal_registry(rows.sparkSession).select("signal", "higher_means_more_uncertain"))
    return rows.join(spec, "signal").withColumn("u", F.when(F.col("higher_means_more_uncertain"), F.col("value")).otherwise(-F.col("value"))).drop("higher_means_more_uncertain")


def available_signals(rows: DataFrame, by: tuple[str, ...] = ("task",)) -> DataFrame:
    """Signals with two finite values and two distinct ones at least, with counts. Least and greatest tell
    whether values differ, in one partial aggregation."""
    good = F.when(finite(F.col("value")), F.col("value"))
    found = rows.groupBy(*by, "signal").agg(F.count(good).alias("n_finite"), F.min(good).alias("least"), F.max(good).alias("greatest"))
    usable = found.where((F.col("n_finite") >= 2) & (F.col("least") < F.col("greatest"))).select(*by, "signal", "n_finite")
    return usable.join(F.broadcast(signal_registry(rows.sparkSession).select("signal", "ordinal")), "signal")


def degenerate_signals(rows: DataFrame, by: tuple[str, ...] = ("task",)) -> DataFrame:
    return rows.select(*by, "signal").distinct().join(available_signals(rows, by), [*by, "signal"], "left_anti")


def separation(rows: DataFrame, by: tuple[str, ...] = ("task", "signal")) -> DataFrame:
    """Mean value when right and when wrong, and their gap, over finite values."""
    good = rows.where(finite(F.col("value")))
    out = good.groupBy(*by).agg(F.avg(F.when(F.col("ok"), F.col("value"))).alias("mean_when_correct"), F.avg(F.when(~F.col("ok"), F.col("value"))).alias("mean_when_wrong"))
    return out.withColumn("gap", F.col("mean_when_wrong") - F.col("mean_when_correct"))
