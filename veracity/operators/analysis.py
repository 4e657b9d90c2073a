"""The evaluation of all signals at once, their ranking, and the decisions built on the best of them.

Rows are (task, example_id, signal, value, ok, pos, split); every signal is evaluated in one grouped plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import finite
from ..session import checkpointed
from . import calibrate, decisions, metrics
from .registry import BOOTSTRAP, SEED, signal_registry, target_ladder
from .signals import available_signals, long_signals, to_uncertainty
from .split import dev_test_split

KEYS = ["task", "signal"]


def usable(rows: DataFrame, where: str = "test") -> DataFrame:
    """Finite, oriented rows of the signals that vary on the rows of a split ('all': on all rows)."""
    judged = rows if where == "all" else rows.where(F.col("split") == where)
    keep = available_signals(judged).select(*KEYS)  # 26 rows a task at most
    return to_uncertainty(rows.join(F.broadcast(keep), KEYS)).where(finite(F.col("u")))


def calibrated(oriented: DataFrame) -> DataFrame:
    """Test rows with `conf`, from calibrators fitted on dev."""
    model = calibrate.fit(oriented.where("split = 'dev'"), KEYS)
    return calibrate.predict(oriented.where("split = 'test'"), model, KEYS)


def ranked(evaluations: DataFrame, by: str = "auroc") -> DataFrame:
    """evaluations with `rank` in each task: best first, undefined last, ties in registry order. One row a signal."""
    if "ordinal" not in evaluations.columns:
        evaluations = evaluations.join(F.broadcast(signal_registry(evaluations.sparkSession).select("signal", "ordinal")), "signal")
    order = Window.partitionBy("task").orderBy(F.coalesce(F.isnan(by), F.lit(True)), F.col(by).desc(), "ordinal")
    return evaluations.withColumn("rank", F.row_number().over(order))


def evaluate_signals(rows: DataFrame, replicates: int = BOOTSTRAP, seed: int = SEED, mode: str = "multinomial") -> DataFrame:
    """One ranked row a signal: AUROC and AURC with intervals, both calibration errors, Brier score."""
    oriented = checkpointed(usable(rows))
    test = oriented.where("split = 'test'")
    conf = checkpointed(calibrated(oriented))
    if mode == "multinomial":  # the same draws for both
        out = metrics.bootstrap(test, KEYS, replicates=replicates, metric=("auroc", "aurc"), seed=seed)
    else:
        span = lambda m: metrics.bootstrap(test, KEYS, replicates=replicates, metric=(m,), seed=seed, mode=mode)
        out = span("auroc").join(span("aurc"), KEYS, "left")
    ece = lambda s: metrics.calibration_error(metrics.reliability(conf, KEYS, strategy=s), KEYS).toDF(*KEYS, f"ece_{s}", f"mce_{s}")
    for part in (ece("fixed_width"), ece("equal_mass"), metrics.brier(conf, KEYS)):
        out = out.join(part, KEYS, "left")
    return ranked(out)


def top_signals(evaluations: DataFrame, n: int = 3) -> DataFrame:
    """The first n of each task, without those that have no AUROC."""
    return evaluations.where((F.col("rank") <= n) & finite(F.col("auroc")))


def best_signal(evaluations: DataFrame, cost_tier: str | None = None) -> DataFrame:
    """task, signal of the first rank (of a cost tier, if given)."""
    rows = evaluations
    if cost_tier:
        tiers = signal_registry(rows.sparkSession).where(F.col("cost_tier") == cost_tier).select("signal")
        rows = ranked(rows.drop("rank").join(F.broadcast(tiers), "signal"))
    return rows.where("rank = 1").select("task", "signal")


def signal_rows(records: DataFrame) -> DataFrame:
    """Rows of record tables, split into dev and test before the signals become rows."""
    halves = dev_test_split(records.withColumn("ok", F.col("greedy_correct")))
    return long_signals(halves, keep=("task", "example_id", "ok", "majority_correct", "pos", "split"))


def reliability_for_signals(rows: DataFrame, chosen: DataFrame, strategy: str) -> DataFrame:
    """Bins of the test rows of chosen(task, signal)."""
    conf = calibrated(usable(rows).join(F.broadcast(chosen), KEYS))
    return metrics.reliability(conf, KEYS, strategy=strategy)


def analyse(records: DataFrame, replicates: int = BOOTSTRAP, select_on: str = "test", gate_tier: str | None = None) -> DataFrame:
    """One nested row a task: evaluations, selective points, tiers and (for gsm8k) the cascade.

    select_on='dev' ranks signals for the choice on dev rows; gate_tier restricts the cascade's
    gate to one cost tier. The defaults are test and no restriction."""
    rows = checkpointed(signal_rows(records))
    evaluations = checkpointed(evaluate_signals(rows, replicates))  # read by all that follows
    oriented = checkpointed(usable(rows))
    if select_on == "test":
        choice = evaluations
    else:
        dev = usable(rows, "dev").where("split = 'dev'")
        choice = ranked(metrics.auroc(metrics.rank_table(dev, KEYS), KEYS))
    best = checkpointed(best_signal(choice))
    of = lambda b: oriented.join(F.broadcast(b), KEYS)  # noqa: E731  one signal a task
    chosen = checkpointed(of(best))
    dev, test = chosen.where("split = 'dev'"), chosen.where("split = 'test'")
    tasks = [r["task"] for r in rows.select("task").distinct().collect()]
    points = checkpointed(decisions.selective_answering(dev, test, target_ladder(rows.sparkSession, tasks), KEYS))
    tiers = checkpointed(decisions.confidence_tiers(dev, test, KEYS))
    gate = of(best_signal(choice, gate_tier)).where("task = 'gsm8k'").withColumn("greedy_ok", F.col("ok")).withColumn("majority_ok", F.col("majority_correct"))
    gate = checkpointed(gate)
    curve = checkpointed(decisions.cascade_curve(gate.where("split = 'dev'"), gate.where("split = 'test'"), KEYS))
    selected = decisions.cheapest_point(curve, KEYS).select("task", F.struct("signal", "budget", "threshold", "test_rate", "test_accuracy", "mean_generations", "cost_ratio").alias("selected"))
    listed = lambda df, name, *cols: df.groupBy("task").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))  # noqa: E731  a few rows a task
    curves = listed(curve, "curve", "step", "budget", "threshold", "test_rate", "test_accuracy", "mean_generations", "cost_ratio").join(selected, "task")
    accuracy = rows.where("split = 'test'").select("task", "example_id", "ok").distinct().groupBy("task").agg(F.avg(F.col("ok").cast("double")).alias("greedy_accuracy"), F.count("*").alias("n_test"))
    out = accuracy.join(best.withColumnRenamed("signal", "best_signal"), "task").join(listed(evaluations, "evaluations", "rank", "signal", "auroc", "auroc_lower", "auroc_upper", "aurc", "aurc_lower", "aurc_upper", "ece_fixed_width", "ece_equal_mass", "brier"), "task")
    out = out.join(listed(points, "selective", "target", "threshold", "dev_coverage", "dev_accuracy", "test_coverage", "test_accuracy", "test_answered", "met"), "task")
    out = out.join(listed(tiers, "tiers", "rank", "tier", "n", "share", "accuracy"), "task").join(decisions.tier_separation(tiers, ["task"]), "task")
    return out.join(curves.select("task", F.struct("curve", "selected").alias("cascade")), "task", "left")
