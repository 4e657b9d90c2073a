"""Report tables over evaluations, tiers and cascades. All are small joins or aggregations of few rows a task,
but for those that read the signals themselves (histogram, worked and flipped examples)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import finite
from .metrics import quantiles, rank_table
from .registry import COST_FIELDS, SPAN_PREFIX, signal_registry

NAN = float("nan")
LEAST_GAIN = 1e-9


def cost_by_tier(records: DataFrame) -> DataFrame:
    """task, cost_tier, mean_seconds: each tier's fields summed (missing ones are 0), averaged over all records."""
    costs = [F.struct(F.lit(t).alias("cost_tier"), sum((F.coalesce(F.col(f"timings.{f}"), F.lit(0.0)) for f in fields), F.lit(0.0)).alias("s")) for t, fields in COST_FIELDS.items()]
    return records.select("task", F.explode(F.array(*costs)).alias("c")).groupBy("task", "c.cost_tier").agg(F.avg("c.s").alias("mean_seconds"))


def cost_ratio(costs: DataFrame) -> DataFrame:
    """task, single_pass, multi_sample and how many times the one the other costs (NaN where a single pass costs nothing)."""
    of = lambda t: F.max(F.when(F.col("cost_tier") == t, F.col("mean_seconds"))).alias(t)
    both = costs.groupBy("task").agg(of("single_pass"), of("multi_sample"))
    return both.withColumn("ratio", F.when(F.col("single_pass") > 0, F.col("multi_sample") / F.col("single_pass")).otherwise(NAN))


def same_winner(evaluations: DataFrame) -> DataFrame:
    """One row: whether one signal leads all tasks, and which leads each. A row a task is read."""
    first = evaluations.where("rank = 1").groupBy("task").agg(F.min("signal").alias("signal"))
    named = F.array_sort(F.collect_list(F.concat("task", F.lit(": "), "signal")))
    return first.agg((F.count_distinct("signal") == 1).alias("same"), F.array_join(named, ", ").alias("winners"))


def base_error_rate(rows: DataFrame, by: tuple[str, ...] = ("task",)) -> DataFrame:
    return rows.groupBy(*by).agg((1 - F.avg(F.col("ok").cast("double"))).alias("base_error_rate"))


def results_table(evaluations: DataFrame, n: int = 14) -> DataFrame:
    return evaluations.where(F.col("rank") <= n)


def span_pairs(evaluations: DataFrame, metric: str = "auroc") -> DataFrame:
    """task, signal, full and answer-span metric, and their difference."""
    span = evaluations.where(F.col("signal").startswith(SPAN_PREFIX)).select("task", F.expr(f"substr(signal, {len(SPAN_PREFIX) + 1})").alias("signal"), F.col(metric).alias("span"))
    return evaluations.select("task", "signal", F.col(metric).alias("full")).join(span, ["task", "signal"]).withColumn("delta", F.col("span") - F.col("full"))


def span_finding(evaluations: DataFrame) -> DataFrame:
    """task, pairs, mean delta, how many improved."""
    good = span_pairs(evaluations).where(finite(F.col("delta")))
    return good.groupBy("task").agg(F.count("*").alias("n_pairs"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("n_improved"))


def best_free_signal(evaluations: DataFrame) -> DataFrame:
    """The best single-pass signal of each task beside the best of all: gap, and whether intervals overlap."""
    tiers = F.broadcast(signal_registry(evaluations.sparkSession).select("signal", "cost_tier"))
    rows = evaluations.where(finite(F.col("auroc"))).join(tiers, "signal")
    order = F.struct("auroc", -F.col("rank"))
    free = rows.where("cost_tier = 'single_pass'").groupBy("task").agg(F.max_by(F.struct("signal", "auroc", "auroc_upper"), order).alias("f"))
    best = rows.groupBy("task").agg(F.max_by(F.struct("signal", "auroc", "auroc_lower"), order).alias("b"))
    return free.join(best, "task").select("task", F.col("f.signal").alias("free_signal"), F.col("f.auroc").alias("free_auroc"), F.col("b.signal").alias("best_signal"), F.col("b.auroc").alias("best_auroc"), (F.col("b.auroc") - F.col("f.auroc")).alias("gap"), (F.col("f.auroc_upper") >= F.col("b.auroc_lower")).alias("overlap"))


def cost_versus_quality(evaluations: DataFrame, costs: DataFrame) -> DataFrame:
    """The best signal of each cost tier beside the tier's mean seconds."""
    tiers = F.broadcast(signal_registry(evaluations.sparkSession).select("signal", "cost_tier"))
    rows = evaluations.where(finite(F.col("auroc"))).join(tiers, "signal")
    best = rows.groupBy("task", "cost_tier").agg(F.max_by(F.struct("signal", "auroc"), F.struct("auroc", -F.col("rank"))).alias("b"))
    return best.join(costs, ["task", "cost_tier"]).select("task", "cost_tier", F.col("b.signal").alias("signal"), F.col("b.auroc").alias("auroc"), "mean_seconds")


def interval_bars(evaluations: DataFrame, n: int = 12) -> DataFrame:
    """The first n finite signals with the half-widths of their intervals, never negative."""
    good = evaluations.where(finite(F.col("auroc")))
    order = Window.partitionBy("task").orderBy("rank")
    bars = good.withColumn("bar", F.row_number().over(order)).where(F.col("bar") <= n)
    width = lambda c: F.greatest(c, F.lit(0.0))
    return bars.select("task", "bar", "signal", "auroc", width(F.col("auroc") - F.col("auroc_lower")).alias("down"), width(F.col("auroc_upper") - F.col("auroc")).alias("up"))


def targets_met(points: DataFrame) -> DataFrame:
    return points.groupBy("task").agg(F.count("*").alias("n_targets"), F.count_if("met").alias("n_met"))


def tier_verdict(separation: DataFrame, least: float = 0.1) -> DataFrame:
    return separation.withColumn("separates", F.coalesce(finite(F.col("gap")) & (F.col("gap") > least), F.lit(False)))


def policy_comparison(selected: DataFrame, baselines: DataFrame) -> DataFrame:
    """The cascade's chosen point against never and always sampling: the gain of sampling, what the
    cascade recovers of it, and the share (NaN where sampling gains nothing)."""
    both = selected.join(baselines, [c for c in ("task", "signal") if c in selected.columns and c in baselines.columns])
    gain, recovered = F.col("majority_accuracy") - F.col("greedy_accuracy"), F.col("test_accuracy") - F.col("greedy_accuracy")
    return both.withColumn("gain", gain).withColumn("recovered", recovered).withColumn("recovered_share", F.when(F.abs(gain) > LEAST_GAIN, recovered / gain).otherwise(NAN))


def ablation_pivot(evaluations: DataFrame, tasks: list[str], metric: str = "auroc") -> DataFrame:
    """signal by task."""
    return evaluations.groupBy("signal").pivot("task", tasks).agg(F.first(metric))


def worked_examples(rows: DataFrame, order: list[str], per_tier: int = 2, tiers: tuple[str, ...] = ("High", "Low")) -> DataFrame:
    """The first examples of each tier. A top-n: tasks keep `per_tier` rows a group each (Spark limits the
    window by rank before the shuffle)."""
    place = Window.partitionBy("task", "tier").orderBy(*order)
    return rows.where(F.col("tier").isin(*tiers)).withColumn("place", F.row_number().over(place)).where(F.col("place") <= per_tier)


def flipped_examples(rows: DataFrame, order: list[str], n: int | None = 3) -> DataFrame:
    """Rows that the majority got right and the greedy answer didn't."""
    flipped = rows.where(~F.col("greedy_ok") & F.col("majority_ok")).orderBy(*order)
    return flipped if n is None else flipped.limit(n)


def signal_histogram(rows: DataFrame, by: list[str], value: str = "value", bins: int = 23) -> DataFrame:
    """by..., ok, bin, lower, n over shared edges from least to greatest finite value; the last bin is closed."""
    good = rows.where(finite(F.col(value)))
    ends = good.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))  # one row a group
    step = (F.col("_b") - F.col("_a")) / bins
    place = F.when(step > 0, F.least(F.floor((F.col(value) - F.col("_a")) / step), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
    counted = good.join(F.broadcast(ends), by).withColumn("bin", place).groupBy(*by, "ok", "bin").agg(F.count("*").alias("n"), F.first("_a").alias("_a"), F.first("_b").alias("_b"))
    return counted.select(*by, "ok", "bin", (F.col("_a") + F.col("bin") * step).alias("lower"), "n")


def group_medians(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Exact medians of right and wrong rows."""
    table = rank_table(rows.withColumn("_ok", F.lit(True)), [*by, "ok"], value, "_ok")
    return quantiles(table, [*by, "ok"], {"median": 0.5})


def shown(c: Column, places: int = 6) -> Column:
    """A number as results give it: rounded, never -0, null unless finite."""
    r = F.round(c, places)
    return F.when(finite(c), F.when(r == 0, F.lit(0.0)).otherwise(r))
