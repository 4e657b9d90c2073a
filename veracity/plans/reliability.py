"""Queries over signals, metrics, decisions and reports, with their expected results in DuckDB SQL."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, calibrate, decisions, metrics, reports, resample
from ..operators import signals as sg
from ..operators.registry import BOOTSTRAP, BUDGETS, NEAR_BEST, NUM_BINS, NUM_SAMPLES, TARGETS, TIER_CUTS, target_ladder
from ..operators.reports import shown
from ..operators.split import dev_test_split
from ..session import checkpointed
from ..sources import adapters as ad
from ..sources.records import load_task
from . import oracle
from .oracle import DEV, ON_TEST, TEST, signals
from .oracle import shown as sql_shown

KEYS = analysis.KEYS
TASKS = ["gsm8k", "nq_open"]
#: Replicates of the intervals in these queries and in their SQL.
REPLICATES = BOOTSTRAP


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents as counts, read from the texts once, with their half."""
    return dev_test_split(checkpointed(ad.scored_docs(spark, sf_dir).withColumn("example_id", F.col("doc_id"))))


def _long(docs: DataFrame, *keep: str) -> DataFrame:
    values = F.create_map(*[x for k, v in ad.doc_values().items() for x in (F.lit(k), v.cast("double"))])
    return sg.long_signals(docs.withColumn("signals", values), keep=("task", "example_id", "ok", *keep))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(checkpointed(_halves(spark, sf_dir)), "pos", "split")


def _unsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(checkpointed(ad.scored_docs(spark, sf_dir).withColumn("example_id", F.col("doc_id"))))


def _test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(analysis.usable(_rows(spark, sf_dir)).where("split = 'test'"))


def _each(df: DataFrame, keys: list[str], *numbers: str) -> DataFrame:
    return df.select(*keys, *[shown(F.col(c)).alias(c) for c in numbers])


def auroc_by_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analysis.ranked(metrics.auroc(metrics.rank_table(checkpointed(analysis.usable(_unsplit(spark, sf_dir), "all")), KEYS), KEYS))
    return found.select(*KEYS, shown(F.col("auroc")).alias("auroc"), "n_wrong", "n_right", F.col("rank").cast("long").alias("rank"))


def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "nq_open").otherwise("gsm8k").alias("task"), F.col("n_chars").cast("double").alias("u"))
    return metrics.average_ranks(docs, ["task"]).select("doc_id", "task", shown(F.col("avg_rank")).alias("avg_rank"))


def signal_rows_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(analysis.usable(_unsplit(spark, sf_dir), "all"), ["task", "example_id", "signal"], "u")


def available_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.available_signals(_rows(spark, sf_dir).where("split = 'test'")).select(*KEYS, "n_finite")


def degenerate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.degenerate_signals(_rows(spark, sf_dir).where("split = 'test'"))


def separation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(sg.separation(_unsplit(spark, sf_dir)), KEYS, "mean_when_correct", "mean_when_wrong", "gap")


def dev_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _halves(spark, sf_dir).select("doc_id", "task", F.col("position").cast("long").alias("position"), "split")


def accuracy_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(metrics.accuracy(_halves(spark, sf_dir), ["task", "split"]), ["task", "split", "n"], "accuracy")


def risk_coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(metrics.risk_coverage(_test(spark, sf_dir), KEYS), [*KEYS, "pos", "rank"], "coverage", "risk")


def aurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(metrics.aurc(metrics.risk_coverage(_test(spark, sf_dir), KEYS), KEYS), KEYS, "aurc")


def _oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(analysis.usable(_rows(spark, sf_dir)))  # dev and test are read several times


def logistic_calibrator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(calibrate.fit(_oriented(spark, sf_dir).where("split = 'dev'"), KEYS), KEYS, "w", "b", "base")


def _bins(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    return metrics.reliability(analysis.calibrated(_oriented(spark, sf_dir)), KEYS, strategy=strategy)


def _shown_bins(bins: DataFrame) -> DataFrame:
    return _each(bins.withColumn("bin", F.col("bin").cast("long")), [*KEYS, "bin", "n"], "mean_conf", "accuracy")


def reliability_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_bins(_bins(spark, sf_dir, "fixed_width"))


def reliability_equal_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_bins(_bins(spark, sf_dir, "equal_mass"))


def ece_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(metrics.calibration_error(_bins(spark, sf_dir, "fixed_width"), KEYS), KEYS, "ece", "mce")


def ece_equal_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(metrics.calibration_error(_bins(spark, sf_dir, "equal_mass"), KEYS), KEYS, "ece", "mce")


def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(metrics.brier(analysis.calibrated(_oriented(spark, sf_dir)), KEYS), KEYS, "brier")


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked AUROCs of the test rows with intervals."""
    found = metrics.bootstrap(_test(spark, sf_dir), KEYS, replicates=REPLICATES).toDF(*KEYS, "auroc", "auroc_lower", "auroc_upper")
    return analysis.ranked(found)


def bootstrap_auroc_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_intervals(spark, sf_dir).withColumn("rank", F.col("rank").cast("long")), [*KEYS, "rank"], "auroc", "auroc_lower", "auroc_upper")


def bootstrap_aurc_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(metrics.bootstrap(_test(spark, sf_dir), KEYS, replicates=REPLICATES, metric="aurc"), KEYS, "value", "lower", "upper")


def _supplied(spark: SparkSession, sf_dir: str, metric: resample.Metric) -> DataFrame:
    """Intervals of a metric of confidences, which a caller supplies."""
    return _each(metrics.bootstrap(checkpointed(analysis.calibrated(_oriented(spark, sf_dir))), KEYS, replicates=REPLICATES, metric=metric), KEYS, "value", "lower", "upper")


def bootstrap_brier_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplied(spark, sf_dir, resample.brier_metric())


def bootstrap_ece_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supplied(spark, sf_dir, resample.ece_metric(NUM_BINS))


def bootstrap_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for large groups: independent counts by row, one pass."""
    return _each(metrics.bootstrap(_test(spark, sf_dir), KEYS, replicates=REPLICATES, mode="poisson"), KEYS, "value", "lower", "upper")


def interval_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(reports.interval_bars(_intervals(spark, sf_dir)).withColumn("bar", F.col("bar").cast("long")), ["task", "bar", "signal"], "auroc", "down", "up")


def best_free_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(reports.best_free_signal(_intervals(spark, sf_dir)), ["task", "free_signal", "best_signal", "overlap"], "free_auroc", "best_auroc", "gap")


def _ranked_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.ranked(metrics.auroc(metrics.rank_table(_test(spark, sf_dir), KEYS), KEYS))


def top_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(analysis.top_signals(_ranked_test(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long")), [*KEYS, "rank"], "auroc")


def span_vs_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(reports.span_pairs(_ranked_test(spark, sf_dir)), KEYS, "full", "span", "delta")


def span_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(reports.span_finding(_ranked_test(spark, sf_dir)), ["task", "n_pairs", "n_improved"], "mean_delta")


def ablation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(reports.ablation_pivot(_ranked_test(spark, sf_dir), TASKS), ["signal"], *TASKS)


def cost_versus_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(reports.cost_versus_quality(_ranked_test(spark, sf_dir), reports.cost_by_tier(ad.timings(spark, sf_dir))), ["task", "cost_tier", "signal"], "auroc", "mean_seconds")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _oriented(spark, sf_dir)
    return decisions.selective_answering(rows.where("split = 'dev'"), rows.where("split = 'test'"), target_ladder(spark, list(TARGETS)), KEYS)


def selective_answering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_points(spark, sf_dir), [*KEYS, "target", "test_answered", "met"], "threshold", "dev_coverage", "dev_accuracy", "test_coverage", "test_accuracy")


def targets_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.targets_met(_points(spark, sf_dir))


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _oriented(spark, sf_dir)
    return decisions.confidence_tiers(rows.where("split = 'dev'"), rows.where("split = 'test'"), KEYS)


def confidence_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_tiers(spark, sf_dir), [*KEYS, "tier", "n"], "share", "accuracy")


def tier_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(reports.tier_verdict(decisions.tier_separation(_tiers(spark, sf_dir), KEYS)), [*KEYS, "separates"], "gap")


def base_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk at full coverage that a curve is read against."""
    return _each(reports.base_error_rate(_halves(spark, sf_dir).where("split = 'test'")), ["task"], "base_error_rate")


def cost_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(reports.cost_ratio(reports.cost_by_tier(ad.timings(spark, sf_dir))), ["task"], "single_pass", "multi_sample", "ratio")


def same_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.same_winner(_ranked_test(spark, sf_dir))


def worked_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All test rows of one signal, also those without a value (they are Low)."""
    rows = sg.to_uncertainty(_rows(spark, sf_dir).where("signal = 'answer_max_entropy'"))
    cuts = decisions.tier_cuts(rows.where("split = 'dev'"), ["task"])
    tier = decisions.confidence_tier(F.col("u"), F.col("cut_high"), F.col("cut_medium"))
    tagged = rows.where("split = 'test'").join(F.broadcast(cuts), "task").withColumn("tier", tier)
    return reports.worked_examples(tagged, ["pos"]).select("task", "tier", F.col("place").cast("long").alias("place"), "example_id", "ok")


def signal_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(reports.signal_histogram(_unsplit(spark, sf_dir), KEYS), [*KEYS, "ok", "bin", "n"], "lower")


def group_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(reports.group_medians(_unsplit(spark, sf_dir), KEYS), [*KEYS, "ok"], "median")


def _cascade_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = checkpointed(dev_test_split(checkpointed(ad.cascade_rows(spark, sf_dir)), key="prompt_id"))  # both halves are read several times
    return rows.where("split = 'dev'"), rows.where("split = 'test'")


def cascade_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = decisions.cascade_curve(*_cascade_halves(spark, sf_dir), ["task"])
    return _each(curve.withColumn("step", F.col("step").cast("long")), ["task", "step", "budget"], "threshold", "dev_accuracy", "test_rate", "test_accuracy", "mean_generations", "cost_ratio")


def _chosen(dev: DataFrame, test: DataFrame) -> DataFrame:
    return decisions.cheapest_point(checkpointed(decisions.cascade_curve(dev, test, ["task"])), ["task"])


def cascade_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_chosen(*_cascade_halves(spark, sf_dir)), ["task", "budget"], "dev_accuracy", "test_rate", "test_accuracy", "mean_generations")


def policy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    dev, test = _cascade_halves(spark, sf_dir)
    found = reports.policy_comparison(_chosen(dev, test), decisions.baselines(test, ["task"]))
    return _each(found, ["task", "n_test"], "greedy_accuracy", "majority_accuracy", "test_accuracy", "gain", "recovered", "recovered_share")


def flipped_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of them."""
    return reports.flipped_examples(ad.cascade_rows(spark, sf_dir), ["prompt_id"], n=None).select("prompt_id", shown(F.col("u")).alias("u"))


def seeded_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded take of 100 questions, numbered in taken order; a part without a name has no alias."""
    rows = ad.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat(F.lit(" "), F.col("p_brand"), F.lit("? ")).alias("question"), F.when(F.col("p_partkey") % 10 == 3, F.array().cast("array<string>")).otherwise(F.array("p_name")).alias("answer"))
    return load_task("nq_open", rows, 100, 42).select("example_id", "question", F.array_join("gold_answers", "|").alias("gold"), F.element_at("metadata", "num_aliases").alias("num_aliases"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record-shaped rows; every third wrong answer is one that the majority gets right."""
    values = ad.doc_values()
    return checkpointed(ad.scored_docs(spark, sf_dir)).select("task", F.format_string("%s-%08d", "task", "doc_id").alias("example_id"), F.col("ok").alias("greedy_correct"), (F.col("ok") | (F.col("doc_id") % 3 == 0)).alias("majority_correct"), sg.signal_map(values).alias("signals"))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure of every signal in one table."""
    return analysis.evaluate_signals(_rows(spark, sf_dir), replicates=REPLICATES).select(*KEYS, "rank", *[shown(F.col(c)).alias(c) for c in ("auroc", "auroc_lower", "auroc_upper", "aurc", "aurc_lower", "aurc_upper", "ece_fixed_width", "ece_equal_mass", "brier")])


def task_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested result of a task as JSON."""
    found = analysis.analyse(_records(spark, sf_dir))
    return found.select("task", "best_signal", shown(F.col("greedy_accuracy")).alias("greedy_accuracy"), F.size("evaluations").alias("n_signals"), F.to_json(F.struct(*found.columns)).alias("analysis"))


def task_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure of the nested results of all tasks, a row each: of the signals, the operating points, the tiers and the cascade."""
    found = checkpointed(analysis.analyse(_records(spark, sf_dir)))

    def listed(name: str, label: Column, *figures: str) -> DataFrame:
        rows = found.select("task", F.explode(name).alias("x"))
        pairs = F.array(*[F.struct(F.concat(F.lit(f"{name} "), label, F.lit(f" {f}")).alias("figure"), F.col(f"x.{f}").cast("double").alias("value")) for f in figures])
        return rows.select("task", F.explode(pairs).alias("p")).select("task", "p.*")

    parts = [
        found.select("task", F.concat(F.lit("best signal "), "best_signal").alias("figure"), F.col("greedy_accuracy").alias("value")),
        found.select("task", F.lit("gap of the tiers").alias("figure"), F.col("gap").alias("value")),
        listed("evaluations", F.col("x.signal"), "rank", "auroc", "auroc_lower", "auroc_upper", "aurc", "aurc_lower", "aurc_upper", "ece_fixed_width", "ece_equal_mass", "brier"),
        listed("selective", F.format_string("%.2f", "x.target"), "threshold", "dev_coverage", "dev_accuracy", "test_coverage", "test_accuracy", "met"),
        listed("tiers", F.col("x.tier"), "n", "share", "accuracy"),
    ]
    return functools.reduce(DataFrame.unionByName, parts).select("task", "figure", shown(F.col("value")).alias("value"))


QUERIES = {
    f.__name__: f
    for f in (
        auroc_by_signal, average_ranks, signal_rows_long, available_signals, degenerate_signals, separation_table, accuracy_by_split, risk_coverage_curve, aurc, logistic_calibrator, reliability_fixed, reliability_equal_mass,
        ece_fixed, ece_equal_mass, brier, bootstrap_auroc_ci, bootstrap_aurc_ci, bootstrap_brier_ci, bootstrap_ece_ci, bootstrap_poisson, interval_bars, best_free_signal, top_signals, span_vs_full, span_finding, ablation_pivot, cost_versus_quality, selective_answering, targets_met,
        confidence_tiers, tier_gap, worked_examples, signal_histogram, group_medians, cascade_curve, cascade_selected, policy_comparison, flipped_examples, seeded_examples, evaluations, task_analysis, task_figures, base_error_rate, cost_ratio, same_winner,
    )
} | {"dev_test_split": dev_test}

_ALL, _ONE = signals(), "task, signal"
_RANK = "row_number() OVER (PARTITION BY task ORDER BY auroc IS NULL, auroc DESC, ordinal)"
_TEST_AUROC = [TEST, oracle.AUROC.format(rows="test"), f"ranked AS (SELECT a.*, r.ordinal, r.tier, {_RANK} AS rank FROM auroc a JOIN registry r USING (signal))"]
_CONF = [DEV, TEST, *oracle.calibrated()]
_INTERVALS = [*_TEST_AUROC, *oracle.bootstrap_values("test", REPLICATES), "ci AS (SELECT task, signal, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper FROM each GROUP BY ALL)", "spans AS (SELECT * FROM ranked LEFT JOIN ci USING (task, signal))"]
_CI = "(SELECT task, signal, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper FROM {each} GROUP BY ALL)"
_EVALUATED = [
    *_TEST_AUROC, *oracle.draws("test", REPLICATES), *[x.replace("each AS", "each_auroc AS") for x in oracle.EACH["auroc"]], *[x.replace("each AS", "each_aurc AS") for x in oracle.EACH["aurc"]], DEV, *oracle.calibrated(), *oracle.both_errors(),
    f"""evaluated AS MATERIALIZED (SELECT r.task, r.signal, r.rank, r.auroc, a.lower AS auroc_lower, a.upper AS auroc_upper, c.aurc, b.lower AS aurc_lower, b.upper AS aurc_upper, f.ece AS ece_fixed_width, e.ece AS ece_equal_mass, s.brier FROM ranked r
  LEFT JOIN {_CI.format(each="each_auroc")} a USING (task, signal) LEFT JOIN {_CI.format(each="each_aurc")} b USING (task, signal) LEFT JOIN (SELECT task, signal, avg(wrong_so_far / CAST(rank AS DOUBLE)) AS aurc FROM placed GROUP BY ALL) c USING (task, signal)
  LEFT JOIN ece_fixed_width f USING (task, signal) LEFT JOIN ece_equal_mass e USING (task, signal) LEFT JOIN (SELECT task, signal, avg((conf - CAST(ok AS INT)) * (conf - CAST(ok AS INT))) AS brier FROM conf GROUP BY ALL) s USING (task, signal))""",
]
_FIGURES = ("rank", "auroc", "auroc_lower", "auroc_upper", "aurc", "aurc_lower", "aurc_upper", "ece_fixed_width", "ece_equal_mass", "brier")
_POINTS = [
    DEV, TEST, oracle.CURVE.format(rows="dev"), oracle.LADDER,
    "best AS (SELECT task, signal, target, arg_max(u, rank) AS threshold FROM curve JOIN ladder USING (task) WHERE (rank - wrong) / CAST(rank AS DOUBLE) >= target GROUP BY ALL)",
    "fitted AS (SELECT g.task, g.signal, l.target, coalesce(threshold, CAST('-Infinity' AS DOUBLE)) AS threshold FROM (SELECT DISTINCT task, signal FROM dev) g JOIN ladder l USING (task) LEFT JOIN best USING (task, signal, target))",
    *[f"on_{h} AS (SELECT f.task, f.signal, target, count(CASE WHEN u <= threshold THEN 1 END) AS k, count(u) AS n, avg(CASE WHEN u <= threshold THEN CAST(ok AS INT) END) AS acc FROM fitted f LEFT JOIN {h} USING (task, signal) GROUP BY ALL)" for h in ("dev", "test")],
    "points AS (SELECT f.*, coalesce(d.k / CAST(d.n AS DOUBLE), 0) AS dev_coverage, d.acc AS dev_accuracy, coalesce(t.k / CAST(t.n AS DOUBLE), 0) AS test_coverage, t.acc AS test_accuracy, t.k AS test_answered, coalesce(t.acc >= target, false) AS met FROM fitted f JOIN on_dev d USING (task, signal, target) JOIN on_test t USING (task, signal, target))",
]
_TIERS = [
    DEV, TEST, f"cuts AS (SELECT task, signal, quantile_cont(u, {TIER_CUTS[0]}) AS c1, quantile_cont(u, {TIER_CUTS[1]}) AS c2 FROM dev GROUP BY ALL)",
    "tagged AS (SELECT task, signal, ok, CASE WHEN u <= c1 THEN 'High' WHEN u <= c2 THEN 'Medium' ELSE 'Low' END AS tier FROM test LEFT JOIN cuts USING (task, signal))",
    "totals AS (SELECT task, signal, count(*) AS total FROM tagged GROUP BY ALL)", "counts AS (SELECT task, signal, tier, count(*) AS n, avg(CAST(ok AS INT)) AS acc FROM tagged GROUP BY ALL)",
    "tiers AS (SELECT task, signal, tier, coalesce(n, 0) AS n, coalesce(n, 0) / CAST(total AS DOUBLE) AS share, acc FROM totals CROSS JOIN (VALUES ('High'), ('Medium'), ('Low')) AS t(tier) LEFT JOIN counts USING (task, signal, tier))",
]
_GOLD = "CASE WHEN prompt_id % 2 = 0 THEN 'F' ELSE 'O' END"
_CASCADE = f"""WITH {oracle.SAMPLES.format(answer='o_orderstatus')}, counts AS (SELECT prompt_id, answer, count(*) AS n, min(sample_idx) AS first FROM samples GROUP BY ALL),
won AS (SELECT prompt_id, answer AS majority FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY n DESC, first) AS r FROM counts) WHERE r = 1),
rows_ AS (SELECT prompt_id, 'gsm8k' AS task, -round(avg(logp), 9) AS u, arg_min(answer, sample_idx) = {_GOLD} AS greedy_ok, any_value(majority) = {_GOLD} AS majority_ok FROM samples JOIN won USING (prompt_id) GROUP BY prompt_id),
halves AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42-' || prompt_id), prompt_id) <= round_even(count(*) OVER () * 0.5, 0) THEN 'dev' ELSE 'test' END AS split FROM rows_),
budgets(step, budget, q) AS (VALUES {', '.join(f'({i}, {b}e0, {1.0 - b!r}e0)' for i, b in enumerate(BUDGETS))}),
points AS (SELECT step, budget, CASE WHEN budget <= 0 THEN CAST('Infinity' AS DOUBLE) WHEN budget >= 1 THEN CAST('-Infinity' AS DOUBLE) ELSE (SELECT quantile_cont(u, [{', '.join(f'{1.0 - b!r}' for b in BUDGETS)}]) FROM halves WHERE split = 'dev')[step + 1] END AS threshold FROM budgets),
curve AS (SELECT 'gsm8k' AS task, step, budget, threshold, avg(CASE WHEN split = 'dev' THEN s END) AS dev_accuracy, avg(CASE WHEN split = 'test' THEN s END) AS test_accuracy, avg(CASE WHEN split = 'test' THEN e END) AS test_rate FROM (
  SELECT step, budget, threshold, split, CAST(CASE WHEN u > threshold THEN majority_ok ELSE greedy_ok END AS INT) AS s, CAST(u > threshold AS INT) AS e FROM halves, points) GROUP BY ALL),
chosen AS (SELECT * FROM curve WHERE step = (SELECT min(step) FROM curve WHERE dev_accuracy >= (SELECT max(dev_accuracy) FROM curve) - {NEAR_BEST}))
"""
_COSTS = "costs AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'nq_open' ELSE 'gsm8k' END AS task, tier, avg(CASE WHEN tier = 'single_pass' AND event_type = 'view' OR tier = 'extra_call' AND event_type = 'signup' OR tier = 'multi_sample' AND event_type IN ('click', 'purchase') THEN value ELSE 0e0 END) AS s FROM events, (VALUES ('single_pass'), ('extra_call'), ('multi_sample')) AS t(tier) GROUP BY ALL)"


def _as_records(sql: str) -> str:
    """Rows that are split by their example_id as records have it."""
    return sql.replace("'42-' || doc_id", "'42-' || task || '-' || lpad(CAST(doc_id AS VARCHAR), 8, '0')")


def _num(*names: str) -> str:
    return ", ".join(f"{sql_shown(n)} AS {n}" for n in names)


ORACLE_SQL = {
    "auroc_by_signal": signals(more=[oracle.AUROC.format(rows="u")]) + f"SELECT task, signal, {_num('auroc')}, n_wrong, n_right, {_RANK} AS rank FROM auroc JOIN registry USING (signal)",
    "average_ranks": f"SELECT doc_id, task, {sql_shown('rank() OVER (PARTITION BY task ORDER BY n_chars) + (count(*) OVER (PARTITION BY task, n_chars) - 1) / 2e0')} AS avg_rank FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'nq_open' ELSE 'gsm8k' END AS task FROM documents)",
    "signal_rows_long": _ALL + f"SELECT task, doc_id AS example_id, signal, {_num('u')} FROM u",
    "available_signals": signals(ON_TEST) + "SELECT task, signal, n_finite FROM usable",
    "degenerate_signals": signals(ON_TEST) + "SELECT DISTINCT task, signal FROM long ANTI JOIN usable USING (task, signal)",
    "separation_table": _ALL + f"SELECT task, signal, {_num('mean_when_correct', 'mean_when_wrong')}, {sql_shown('mean_when_wrong - mean_when_correct')} AS gap FROM (SELECT task, signal, avg(CASE WHEN ok THEN value END) AS mean_when_correct, avg(CASE WHEN NOT ok THEN value END) AS mean_when_wrong FROM long WHERE isfinite(value) GROUP BY ALL)",
    "dev_test_split": _ALL + "SELECT doc_id, task, position, split FROM split",
    "accuracy_by_split": _ALL + f"SELECT task, split, count(*) AS n, {sql_shown('avg(CAST(ok AS INT))')} AS accuracy FROM split GROUP BY ALL",
    "risk_coverage_curve": signals(ON_TEST, [TEST, oracle.CURVE.format(rows="test")]) + f"SELECT task, signal, pos, rank, {_num('coverage', 'risk')} FROM curve",
    "aurc": signals(ON_TEST, [TEST, oracle.CURVE.format(rows="test")]) + f"SELECT task, signal, {sql_shown('avg(risk)')} AS aurc FROM curve GROUP BY ALL",
    "logistic_calibrator": signals(ON_TEST, _CONF) + f"SELECT task, signal, {_num('w', 'b', 'base')} FROM model",
    "reliability_fixed": signals(ON_TEST, [*_CONF, oracle.EDGES["fixed_width"], oracle.BINS]) + f"SELECT task, signal, bin, n, {_num('mean_conf', 'accuracy')} FROM bins",
    "reliability_equal_mass": signals(ON_TEST, [*_CONF, oracle.EDGES["equal_mass"], oracle.BINS]) + f"SELECT task, signal, bin, n, {_num('mean_conf', 'accuracy')} FROM bins",
    "ece_fixed": signals(ON_TEST, [*_CONF, oracle.EDGES["fixed_width"], oracle.BINS, oracle.ECE]) + f"SELECT task, signal, {_num('ece', 'mce')} FROM ece",
    "ece_equal_mass": signals(ON_TEST, [*_CONF, oracle.EDGES["equal_mass"], oracle.BINS, oracle.ECE]) + f"SELECT task, signal, {_num('ece', 'mce')} FROM ece",
    "brier": signals(ON_TEST, _CONF) + f"SELECT task, signal, {sql_shown('avg((conf - CAST(ok AS INT)) * (conf - CAST(ok AS INT)))')} AS brier FROM conf GROUP BY ALL",
    "bootstrap_auroc_ci": signals(ON_TEST, _INTERVALS) + f"SELECT task, signal, rank, {_num('auroc')}, {sql_shown('lower')} AS auroc_lower, {sql_shown('upper')} AS auroc_upper FROM spans",
    "bootstrap_aurc_ci": signals(ON_TEST, [TEST, *oracle.bootstrap_values("test", REPLICATES, "aurc")]) + f"SELECT task, signal, {_num('value', 'lower', 'upper')} FROM (SELECT task, signal, avg(wrong_so_far / CAST(rank AS DOUBLE)) AS value FROM placed GROUP BY ALL) LEFT JOIN {_CI.format(each='each')} USING (task, signal)",
    "bootstrap_brier_ci": signals(ON_TEST, [*_CONF, *oracle.bootstrap_values("conf", REPLICATES, "brier")]) + f"SELECT task, signal, {_num('value', 'lower', 'upper')} FROM (SELECT task, signal, avg((conf - CAST(ok AS INT)) * (conf - CAST(ok AS INT))) AS value FROM conf GROUP BY ALL) LEFT JOIN {_CI.format(each='each')} USING (task, signal)",
    "bootstrap_ece_ci": signals(ON_TEST, [*_CONF, oracle.EDGES["fixed_width"], oracle.BINS, oracle.ECE, *oracle.bootstrap_values("conf", REPLICATES, "ece")]) + f"SELECT task, signal, {_num('value', 'lower', 'upper')} FROM (SELECT task, signal, ece AS value FROM ece) LEFT JOIN {_CI.format(each='each')} USING (task, signal)",
    "bootstrap_poisson": signals(ON_TEST, [*_TEST_AUROC, *oracle.poisson_values("test", REPLICATES)]) + f"SELECT task, signal, {sql_shown('auroc')} AS value, {_num('lower', 'upper')} FROM auroc LEFT JOIN {_CI.format(each='each')} USING (task, signal)",
    "evaluations": signals(ON_TEST, _EVALUATED) + f"SELECT task, signal, rank, {_num(*_FIGURES[1:])} FROM evaluated",
    "task_figures": _as_records(signals(ON_TEST, [*_EVALUATED, *[x for x in _POINTS + _TIERS if x not in (DEV, TEST)], "best_signal AS (SELECT task, signal FROM evaluated WHERE rank = 1)"])) + "SELECT task, figure, " + sql_shown("value") + " AS value FROM (" + " UNION ALL ".join([
        "SELECT task, 'best signal ' || signal AS figure, avg(CAST(ok AS INT)) AS value FROM split JOIN best_signal USING (task) WHERE split = 'test' GROUP BY task, signal",
        "SELECT task, 'gap of the tiers', max(CASE WHEN tier = 'High' AND n > 0 THEN acc END) - max(CASE WHEN tier = 'Low' AND n > 0 THEN acc END) FROM tiers JOIN best_signal USING (task, signal) GROUP BY task",
        *[f"SELECT task, 'evaluations ' || signal || ' {f}', CAST({f} AS DOUBLE) FROM evaluated" for f in _FIGURES],
        *[f"SELECT task, 'selective ' || printf('%.2f', target) || ' {f}', CAST({f if f != 'met' else 'CAST(met AS INT)'} AS DOUBLE) FROM points JOIN best_signal USING (task, signal)" for f in ("threshold", "dev_coverage", "dev_accuracy", "test_coverage", "test_accuracy", "met")],
        *[f"SELECT task, 'tiers ' || tier || ' {f}', CAST({c} AS DOUBLE) FROM tiers JOIN best_signal USING (task, signal)" for f, c in (("n", "n"), ("share", "share"), ("accuracy", "acc"))],
    ]) + ")",
    "interval_bars": signals(ON_TEST, _INTERVALS) + f"SELECT task, row_number() OVER (PARTITION BY task ORDER BY rank) AS bar, signal, {_num('auroc')}, {sql_shown('greatest(auroc - lower, 0e0)')} AS down, {sql_shown('greatest(upper - auroc, 0e0)')} AS up FROM spans WHERE auroc IS NOT NULL QUALIFY bar <= 12",
    "best_free_signal": signals(ON_TEST, _INTERVALS) + f"SELECT f.task, f.signal AS free_signal, b.signal AS best_signal, f.upper >= b.lower AS overlap, {sql_shown('f.auroc')} AS free_auroc, {sql_shown('b.auroc')} AS best_auroc, {sql_shown('b.auroc - f.auroc')} AS gap FROM (SELECT * FROM spans WHERE tier = 'single_pass' AND auroc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task ORDER BY rank) = 1) f JOIN (SELECT * FROM spans WHERE rank = 1) b USING (task)",
    "top_signals": signals(ON_TEST, _TEST_AUROC) + f"SELECT task, signal, rank, {_num('auroc')} FROM ranked WHERE rank <= 3 AND auroc IS NOT NULL",
    "span_vs_full": signals(ON_TEST, _TEST_AUROC) + f"SELECT f.task, f.signal, {sql_shown('f.auroc')} AS full, {sql_shown('s.auroc')} AS span, {sql_shown('s.auroc - f.auroc')} AS delta FROM ranked f JOIN ranked s ON f.task = s.task AND s.signal = 'answer_' || f.signal",
    "span_finding": signals(ON_TEST, _TEST_AUROC) + f"SELECT f.task, count(*) AS n_pairs, {sql_shown('avg(s.auroc - f.auroc)')} AS mean_delta, count(CASE WHEN s.auroc > f.auroc THEN 1 END) AS n_improved FROM ranked f JOIN ranked s ON f.task = s.task AND s.signal = 'answer_' || f.signal WHERE f.auroc IS NOT NULL AND s.auroc IS NOT NULL GROUP BY f.task",
    "ablation_pivot": signals(ON_TEST, _TEST_AUROC) + "SELECT signal, " + ", ".join(f"{sql_shown(f'max(CASE WHEN task = {chr(39)}{t}{chr(39)} THEN auroc END)')} AS {t}" for t in TASKS) + " FROM ranked GROUP BY signal",
    "cost_versus_quality": signals(ON_TEST, [*_TEST_AUROC, _COSTS]) + f"SELECT task, tier AS cost_tier, signal, {_num('auroc')}, {sql_shown('s')} AS mean_seconds FROM ranked JOIN costs USING (task, tier) WHERE auroc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, tier ORDER BY rank) = 1",
    "selective_answering": signals(ON_TEST, _POINTS) + f"SELECT task, signal, target, test_answered, met, {_num('threshold', 'dev_coverage', 'dev_accuracy', 'test_coverage', 'test_accuracy')} FROM points",
    "targets_met": signals(ON_TEST, _POINTS) + "SELECT task, count(*) AS n_targets, count(CASE WHEN met THEN 1 END) AS n_met FROM points GROUP BY task",
    "confidence_tiers": signals(ON_TEST, _TIERS) + f"SELECT task, signal, tier, n, {_num('share')}, {sql_shown('acc')} AS accuracy FROM tiers",
    "tier_gap": signals(ON_TEST, _TIERS) + f"SELECT task, signal, coalesce(gap > 0.1, false) AS separates, {_num('gap')} FROM (SELECT task, signal, max(CASE WHEN tier = 'High' THEN acc END) - max(CASE WHEN tier = 'Low' THEN acc END) AS gap FROM tiers GROUP BY ALL)",
    "base_error_rate": _ALL + f"SELECT task, {sql_shown('1 - avg(CAST(ok AS INT))')} AS base_error_rate FROM split WHERE split = 'test' GROUP BY task",
    "cost_ratio": f"WITH {_COSTS}, p AS (SELECT task, max(CASE WHEN tier = 'single_pass' THEN s END) AS single_pass, max(CASE WHEN tier = 'multi_sample' THEN s END) AS multi_sample FROM costs GROUP BY task) SELECT task, {_num('single_pass', 'multi_sample')}, {sql_shown('multi_sample / nullif(single_pass, 0)')} AS ratio FROM p",
    "same_winner": signals(ON_TEST, _TEST_AUROC) + "SELECT count(DISTINCT signal) = 1 AS same, string_agg(task || ': ' || signal, ', ' ORDER BY task) AS winners FROM ranked WHERE rank = 1",
    "worked_examples": _ALL + f"SELECT task, tier, place, doc_id AS example_id, ok FROM (SELECT *, row_number() OVER (PARTITION BY task, tier ORDER BY pos) AS place FROM (SELECT l.*, CASE WHEN isfinite(value) AND value <= c1 THEN 'High' WHEN isfinite(value) AND value <= c2 THEN 'Medium' ELSE 'Low' END AS tier FROM long l JOIN (SELECT task, quantile_cont(value, {TIER_CUTS[0]}) AS c1, quantile_cont(value, {TIER_CUTS[1]}) AS c2 FROM long WHERE signal = 'answer_max_entropy' AND split = 'dev' AND isfinite(value) GROUP BY task) USING (task) WHERE signal = 'answer_max_entropy' AND split = 'test')) WHERE place <= 2 AND tier IN ('High', 'Low')",
    "signal_histogram": _ALL + f"SELECT task, signal, ok, bin, count(*) AS n, {sql_shown('any_value(a + bin * ((b - a) / 23))')} AS lower FROM (SELECT *, CAST(CASE WHEN b > a THEN least(floor((value - a) / ((b - a) / 23)), 22) ELSE 0 END AS BIGINT) AS bin FROM (SELECT *, min(value) OVER w AS a, max(value) OVER w AS b FROM long WHERE isfinite(value) WINDOW w AS (PARTITION BY task, signal))) GROUP BY ALL",
    "group_medians": _ALL + f"SELECT task, signal, ok, {sql_shown('quantile_cont(value, 0.5)')} AS median FROM long WHERE isfinite(value) GROUP BY ALL",
    "cascade_curve": _CASCADE + f"SELECT task, CAST(step AS BIGINT) AS step, budget, {_num('threshold', 'dev_accuracy', 'test_rate', 'test_accuracy')}, {sql_shown(f'1 + test_rate * {NUM_SAMPLES}')} AS mean_generations, {sql_shown(f'(1 + test_rate * {NUM_SAMPLES}) / {1 + NUM_SAMPLES}')} AS cost_ratio FROM curve",
    "cascade_selected": _CASCADE + f"SELECT task, budget, {_num('dev_accuracy', 'test_rate', 'test_accuracy')}, {sql_shown(f'1 + test_rate * {NUM_SAMPLES}')} AS mean_generations FROM chosen",
    "policy_comparison": _CASCADE + f", base AS (SELECT avg(CAST(greedy_ok AS INT)) AS g, avg(CAST(majority_ok AS INT)) AS m, count(*) AS n FROM halves WHERE split = 'test') SELECT task, n AS n_test, {sql_shown('g')} AS greedy_accuracy, {sql_shown('m')} AS majority_accuracy, {_num('test_accuracy')}, {sql_shown('m - g')} AS gain, {sql_shown('test_accuracy - g')} AS recovered, {sql_shown('CASE WHEN abs(m - g) > 1e-9 THEN (test_accuracy - g) / (m - g) END')} AS recovered_share FROM chosen, base",
    "flipped_examples": _CASCADE + f"SELECT prompt_id, {_num('u')} FROM rows_ WHERE NOT greedy_ok AND majority_ok",
    "seeded_examples": "SELECT 'nq_open-' || lpad(CAST(i AS VARCHAR), 5, '0') AS example_id, p_brand || '?' AS question, p_name AS gold, CAST(1 AS BIGINT) AS num_aliases FROM (SELECT *, row_number() OVER (ORDER BY md5('42-' || p_partkey), p_partkey) - 1 AS i FROM part) WHERE i < 100 AND p_partkey % 10 <> 3",
}
