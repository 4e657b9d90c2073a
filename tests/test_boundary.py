"""The pieces that no query runs: model boundary, exploded steps, trims, question sets, metric files, the results table, bins of chosen signals."""

import json
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veracity.operators import analysis, metrics, reports, tokens
from veracity.plans import reliability
from veracity.sources import inference
from veracity.sources import records as files

SF = "/root/testdata/sf0.001"


def test_generate(spark):
    """The generator gets whole batches and the number of samples; its steps become rows and are trimmed."""
    prompts = spark.createDataFrame([(f"e{i}", "x" * i, 9) for i in range(1, 6)], "example_id string, prompt string, other int").repartition(2)

    def generator(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in batch.itertuples():
            for k in range(r.samples):
                n = len(r.prompt) + k
                rows.append((r.example_id, k, r.prompt, list(range(n)), [float(i) for i in range(n)], [0.5] * n, [0.25] * (n + 1), [-1.0] * max(n - 1, 0)))
        return pd.DataFrame(rows, columns=["example_id", "sample_idx", "text", "token_ids", "entropy", "max_probability", "margin", "chosen_log_probability"])

    made = inference.generate(prompts, generator, samples=3)
    assert made.count() == 15 and {r["sample_idx"] for r in made.collect()} == {0, 1, 2}
    steps = inference.exploded_steps(made)
    counts = {r["seq_id"]: r["count"] for r in steps.groupBy("seq_id").count().collect()}
    assert counts == {f"e{i}/{k}": i + k - 1 for i in range(1, 6) for k in range(3) if i + k > 1}  # cut to the shortest array
    assert {tuple(r)[1:] for r in steps.where("seq_id = 'e3/1'").collect()} == {(i, float(i), 0.5, 0.25, -1.0) for i in range(3)}
    lengths = spark.createDataFrame([("e3/1", 2), ("e5/2", 0)], "seq_id string, effective_length int")
    assert [r["step"] for r in tokens.trim_to_length(steps, lengths).orderBy("step").collect()] == [0, 1]
    assert inference.generate(prompts.limit(0), generator).count() == 0


def test_gsm8k(spark):
    rows = spark.createDataFrame([(i, f" What is {i}? ", f"First.\nThen {i}.\n#### {i}" if i % 2 else f"#### {i}") for i in range(20)], "key int, question string, answer string")
    found = files.load_task("gsm8k", rows, 8, 42).orderBy("example_id").collect()
    taken = files.seeded_take(rows, 8, "key", 42).collect()
    assert [r["example_id"] for r in found] == [f"gsm8k-{i:05}" for i in range(8)]
    for r, t in zip(found, taken, strict=True):
        assert r["question"] == t["question"].strip() and r["gold_answers"] == [t["answer"]] and r["metadata"] == {"solution_steps": t["answer"].count("\n") + 1} and r["task"] == "gsm8k"


def test_metric_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", math.nan, [(1, 0.5)])], "task string, gap double, tiers array<struct<rank:int,share:double>>")
    files.save_metrics(rows, str(tmp_path / "m"))
    read = [json.loads(line) for p in (tmp_path / "m").glob("*.json") for line in p.read_text().splitlines()]
    assert read == [{"task": "a", "gap": "NaN", "tiers": [{"rank": 1, "share": 0.5}]}]


@pytest.mark.parametrize("strategy", ["fixed_width", "equal_mass"])
def test_bins_of_chosen_signals(spark, strategy):
    """What the bins of all signals hold for the chosen ones."""
    rows = reliability._rows(spark, SF).where("task = 'nq_open'").cache()
    chosen = spark.createDataFrame([("nq_open", "mean_entropy"), ("nq_open", "lexical_entropy")], "task string, signal string")
    key = lambda df: sorted((r["signal"], r["bin"], r["n"], round(r["mean_conf"], 9), round(r["accuracy"], 9)) for r in df.collect())
    every = metrics.reliability(analysis.calibrated(analysis.usable(rows)), analysis.KEYS, strategy=strategy)
    assert key(analysis.reliability_for_signals(rows, chosen, strategy)) == key(every.where(F.col("signal").isin("mean_entropy", "lexical_entropy")))


def test_results_table(spark):
    rows = [("t", s, r, a, a - 0.1, a + 0.1, 0.3, 0.2, 0.4, 0.1, 0.12, 0.2) for r, (s, a) in enumerate((("semantic_entropy", 0.9), ("mean_entropy", 0.8), ("seq_prob", 0.7)), 1)]
    evaluations = spark.createDataFrame(rows, "task string, signal string, rank int, auroc double, auroc_lower double, auroc_upper double, aurc double, aurc_lower double, aurc_upper double, ece_fixed_width double, ece_equal_mass double, brier double")
    assert [r["signal"] for r in reports.results_table(evaluations, 2).orderBy("rank").collect()] == ["semantic_entropy", "mean_entropy"]
    assert reports.results_table(evaluations).collect()[0]["auroc"] == pytest.approx(0.9) and reports.results_table(evaluations).count() == 3
