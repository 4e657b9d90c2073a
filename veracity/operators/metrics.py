"""Ranking, calibration and resampling metrics over groups.

All rank metrics come from one table of tie groups with running counts. Running counts are taken in two
levels (value ranges, then within a range), so that one group with many values isn't ordered in
one task; equal values are one row there, so that ties can't skew it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import finite
from . import resample
from .registry import BOOTSTRAP, CONFIDENCE, NUM_BINS, SEED

NAN = float("nan")
RANGES = 32


def rank_table(scored: DataFrame, by: list[str], u: str = "u", ok: str = "ok", weight: Column | None = None, ranges: int = RANGES) -> DataFrame:
    """by..., u, n, wrong, below, below_wrong: each distinct finite value with its counts and those of all smaller values."""
    w = F.lit(1).cast("long") if weight is None else weight
    ties = scored.where(finite(F.col(u))).groupBy(*by, F.col(u).alias("u")).agg(F.sum(w).alias("n"), F.sum(F.when(F.col(ok), 0).otherwise(w)).cast("long").alias("wrong"))
    if ranges <= 1:
        before = Window.partitionBy(*by).orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
        run = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
        return ties.select(*by, "u", "n", "wrong", run("n").alias("below"), run("wrong").alias("below_wrong"))
    cuts = ties.groupBy(*by).agg(F.percentile_approx("u", [i / ranges for i in range(1, ranges)], 1000).alias("_cuts"))
    parts = ties.join(cuts, by).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col("u")))).drop("_cuts")
    whole = parts.groupBy(*by, "_r").agg(F.sum("n").alias("_n"), F.sum("wrong").alias("_w"))
    earlier = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*by, "_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"), F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w"))
    before = Window.partitionBy(*by, "_r").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)
    run = lambda c, base: F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(base)
    return parts.join(whole, [*by, "_r"]).select(*by, "u", "n", "wrong", run("n", "_n").alias("below"), run("wrong", "_w").alias("below_wrong"))


def average_ranks(scored: DataFrame, by: list[str], u: str = "u", **options) -> DataFrame:
    """scored (finite values only) with `avg_rank`: ascending from 1, ties share their mean."""
    table = rank_table(scored.withColumn("_ok", F.lit(True)), by, u, "_ok", **options).select(*by, F.col("u").alias(u), (F.col("below") + (F.col("n") + 1) / 2).alias("avg_rank"))
    return scored.join(table, [*by, u])


def auroc(table: DataFrame, by: list[str]) -> DataFrame:
    """Error-detection AUROC from a rank table: wrong is positive, ties count half; NaN without both classes."""
    right, below_right = F.col("n") - F.col("wrong"), F.col("below") - F.col("below_wrong")
    pairs = F.sum(F.col("wrong") * (below_right + right / 2))
    p, n = F.sum("wrong"), F.sum(right)
    return table.groupBy(*by).agg(F.when((p > 0) & (n > 0), pairs / (p.cast("double") * n)).otherwise(NAN).alias("auroc"), p.alias("n_wrong"), n.alias("n_right"))


def quantiles(table: DataFrame, by: list[str], probabilities: dict[str, float]) -> DataFrame:
    """by..., one exact, linearly interpolated quantile column for each name."""
    sizes = table.groupBy(*by).agg(F.sum("n").alias("_total"))
    full = table.join(sizes, by) if by else table.crossJoin(F.broadcast(sizes))  # one row
    at = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("n")), F.col("u")))
    out = []
    for name, q in probabilities.items():
        h = F.lit(q) * (F.col("_total") - 1)
        low, high = at(F.floor(h)), at(F.ceil(h))
        share = F.max(h - F.floor(h))
        out.append((low + (high - low) * share).alias(name))
    return full.groupBy(*by).agg(*out)


def placed(scored: DataFrame, by: list[str], u: str = "u", ok: str = "ok", pos: str = "pos", keep: tuple[str, ...] = (), **options) -> DataFrame:
    """by..., u, ok, pos, tie, rank, wrong_so_far, n, n_wrong and what is kept: rows by u, then by place, with the counts of their group and where their
    tie begins and ends. Within a tie rows are ordered by hash-prefix parts of `pos`, so that one value can't fill a task."""
    rows = scored.where(finite(F.col(u))).select(*by, F.col(u).alias("u"), F.coalesce(F.col(ok), F.lit(False)).alias("ok"), F.col(pos).alias("pos"), F.substring(pos, 1, 2).alias("_s"), *keep)
    table = rank_table(rows, by, "u", "ok", **options)
    wrong = F.when(F.col("ok"), 0).otherwise(1)
    parts = rows.groupBy(*by, "u", "_s").agg(F.count("*").alias("_c"), F.sum(wrong).alias("_e"))
    earlier = Window.partitionBy(*by, "u").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "u", "_s", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_c"), F.coalesce(F.sum("_e").over(earlier), F.lit(0)).alias("_e"))
    tie = F.struct("below", "below_wrong", (F.col("below") + F.col("n")).alias("end"), (F.col("below_wrong") + F.col("wrong")).alias("wrong_end"))
    base = parts.join(table.select(*by, "u", "below", "below_wrong", tie.alias("tie")), [*by, "u"]).select(*by, "u", "_s", (F.col("below") + F.col("_c")).alias("_c"), (F.col("below_wrong") + F.col("_e")).alias("_e"), "tie")
    total = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(wrong).alias("n_wrong"))
    inside = Window.partitionBy(*by, "u", "_s").orderBy("pos")
    ranked = rows.join(base, [*by, "u", "_s"]).select(*by, "u", "ok", "pos", "tie", *keep, (F.row_number().over(inside) + F.col("_c")).alias("rank"), (F.sum(wrong).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_e")).alias("wrong_so_far"))
    return ranked.join(total, by)


def risk_coverage(scored: DataFrame, by: list[str], u: str = "u", ok: str = "ok", pos: str = "pos", **options) -> DataFrame:
    """by..., u, pos, rank, wrong_so_far, coverage, risk: rows by u, then by place."""
    return placed(scored, by, u, ok, pos, **options).select(*by, "u", "pos", "rank", "wrong_so_far", (F.col("rank") / F.col("n")).alias("coverage"), (F.col("wrong_so_far") / F.col("rank")).alias("risk"))


def aurc(curve: DataFrame, by: list[str]) -> DataFrame:
    return curve.groupBy(*by).agg(F.avg("risk").alias("aurc"))


def edges(strategy: str, rows: DataFrame, by: list[str], conf: str, bins: int = NUM_BINS) -> DataFrame:
    """by..., `edges`: inner and outer bin edges of each group."""
    if strategy == "fixed_width":
        return rows.select(*by).distinct().withColumn("edges", F.array(*[F.lit(i * (1.0 / bins)) for i in range(bins)], F.lit(1.0)))
    if strategy != "equal_mass":
        raise ValueError(f"unknown strategy: {strategy}")
    table = rank_table(rows.withColumn("_ok", F.lit(True)), by, conf, "_ok")
    cut = quantiles(table, by, {f"_q{i}": i / bins for i in range(1, bins)})
    return cut.select(*by, F.array_sort(F.array_distinct(F.array(F.lit(0.0), *[F.col(f"_q{i}") for i in range(1, bins)], F.lit(1.0)))).alias("edges"))


def reliability(rows: DataFrame, by: list[str], conf: str = "conf", ok: str = "ok", strategy: str = "fixed_width", bins: int = NUM_BINS) -> DataFrame:
    """by..., bin, lower, upper, n, mean_conf, accuracy for the bins with rows; the last is closed above. Edge
    tables have one row a group."""
    table = edges(strategy, rows, by, conf, bins)
    inner = F.slice("edges", 2, F.size("edges") - 2)
    place = F.when((F.col(conf) >= 0) & (F.col(conf) <= 1), F.size(F.filter(inner, lambda e: e <= F.col(conf))))
    found = rows.join(table, by).withColumn("bin", place)
    return found.groupBy(*by, "bin").agg(F.first("edges").alias("_e"), F.count("*").alias("n"), F.avg(conf).alias("mean_conf"), F.avg(F.col(ok).cast("double")).alias("accuracy")).select(*by, "bin", F.get("_e", F.col("bin")).alias("lower"), F.get("_e", F.col("bin") + 1).alias("upper"), "n", "mean_conf", "accuracy")


def calibration_error(bins: DataFrame, by: list[str]) -> DataFrame:
    """ece and mce; rows outside all edges count in the total only."""
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("mean_conf") - F.col("accuracy")))
    return bins.groupBy(*by).agg((F.sum(F.col("n") * F.coalesce(gap, F.lit(0.0))) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def brier(rows: DataFrame, by: list[str], conf: str = "conf", ok: str = "ok") -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col(conf) - F.col(ok).cast("double"), 2)).alias("brier"))


def bootstrap(scored: DataFrame, by: list[str], u: str = "u", ok: str = "ok", pos: str = "pos", replicates: int = BOOTSTRAP, metric: str | resample.Metric | tuple[str | resample.Metric, ...] = "auroc", confidence: float = CONFIDENCE, seed: int = SEED, mode: str = "multinomial") -> DataFrame:
    """by..., value, lower, upper. Rows are drawn with replacement, paired, as counts per row; replicates
    without a value fall out.

    metric is "auroc", "aurc", any resample.Metric, or a tuple of these, which the same draws serve (by..., then <name>, <name>_lower and <name>_upper
    of each). multinomial draws exactly as many rows as the group has, by splitting (resample.py). poisson gives each row
    an independent count and knows "auroc" only.
    """
    known = {m.name: m for m in (resample.AUROC, resample.AURC)}
    asked = metric if isinstance(metric, tuple) else (metric,)
    if unknown := [m for m in asked if isinstance(m, str) and m not in known]:
        raise ValueError(f"unknown metric: {', '.join(unknown)}")
    chosen = [known[m] if isinstance(m, str) else m for m in asked]
    if mode == "multinomial":
        rows = placed(scored, by, u, ok, pos, tuple(dict.fromkeys(c for m in chosen for c in m.columns if c not in ("u", "ok", "pos"))))
        each = resample.replicate_values(rows, by, chosen, replicates, seed)
    elif mode == "poisson":
        if [m.name for m in chosen] != ["auroc"]:
            raise ValueError("poisson counts are for auroc; draw others with multinomial")
        rows = scored.where(finite(F.col(u))).select(*by, (F.col(u).cast("double") + 0.0).alias("u"), F.coalesce(F.col(ok), F.lit(False)).alias("ok"), F.col(pos).alias("pos"))
        each = resample.poisson_values(rows, by, replicates, seed).withColumnRenamed("value", "auroc")
    else:
        raise ValueError(f"unknown mode: {mode}")
    tail = (1 - confidence) / 2
    # The values of a group's replicates are its few thousand rows here.
    some = lambda c: F.when((F.col("rep") >= 0) & finite(F.col(c)), F.col(c))
    found = each.groupBy(*by).agg(*[x for i, m in enumerate(chosen) for x in (F.max(F.when(F.col("rep") < 0, F.col(m.name))).alias(f"_v{i}"), F.percentile(some(m.name), F.array(F.lit(tail), F.lit(1 - tail))).alias(f"_q{i}"))])
    spans = []
    for i, m in enumerate(chosen):
        names = (m.name, f"{m.name}_lower", f"{m.name}_upper") if isinstance(metric, tuple) else ("value", "lower", "upper")
        spans += [F.coalesce(c, F.lit(NAN)).alias(n) for n, c in zip(names, (F.col(f"_v{i}"), F.get(f"_q{i}", F.lit(0)), F.get(f"_q{i}", F.lit(1))), strict=True)]
    return found.select(*by, *spans)


def accuracy(rows: DataFrame, by: list[str], ok: str = "ok") -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.col(ok).cast("double")).alias("accuracy"), F.count("*").alias("n"))
