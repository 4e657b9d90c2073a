"""The record layer: assembly against plain Python, JSONL files and streams, and the errors that the operators raise."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from veracity.functions import steps, text
from veracity.operators import decisions, metrics, records, registry, reports, signals, split
from veracity.plans.answers import QUERIES
from veracity.sources import adapters, inference
from veracity.sources import records as files
from veracity.streaming import records as streams

SF = "/root/testdata/sf0.001"


def number(t):
    found = re.findall(r"-?\d[\d,]*(?:\.\d+)?", t)
    marked = re.findall(r"-?\d[\d,]*(?:\.\d+)?", t.split("####")[-1]) if "####" in t else []
    return float((marked[0] if marked else found[-1]).replace(",", "")) if found else None


def canonical(t):
    v = number(t)
    return "" if v is None else str(round(v)) if abs(v - round(v)) <= 1e-4 else f"{v:.6g}"


def entropy(counts):
    return -sum(c / sum(counts) * math.log(c / sum(counts)) for c in counts)


@pytest.fixture(scope="module")
def made(spark):
    return records.assemble(*adapters.part_generations(spark, SF), same=lambda a, b: F.length(a) == F.length(b)).cache()


def test_assembly_against_plain_python(spark, made):
    examples, greedy, samples, replies = ({r["example_id"]: r for r in df.collect()} if i != 2 else df.collect() for i, df in enumerate(adapters.part_generations(spark, SF)))
    said: dict = {}
    for r in sorted(samples, key=lambda r: r["sample_idx"]):
        said.setdefault(r["example_id"], []).append((r["text"], sum(r["chosen_log_probability"]) / 2))
    rows = made.collect()
    assert len(rows) == len(examples)
    for r in rows:
        e, g, s = examples[r["example_id"]], greedy[r["example_id"]], said[r["example_id"]]
        gold = number(e["gold_answers"][0])
        ok = lambda v: v is not None and gold is not None and abs(v - gold) <= 1e-4  # noqa: B023, E731
        answers = [canonical(t) for t, _ in s]
        assert r["sample_canonical"] == answers and r["sample_texts"] == [t for t, _ in s]
        assert r["greedy_correct"] == ok(number(g["text"])) and r["greedy_canonical"] == canonical(g["text"])
        assert r["sample_correct"] == [bool(a) and ok(float(a)) for a in answers]
        full = [a for a in answers if a]
        best = max(full, key=lambda a: (full.count(a), -full.index(a)), default="")
        assert r["majority_answer"] == best and r["majority_correct"] == (bool(best) and ok(float(best)))
        heads, labels = [], []
        for a in answers:
            k = next((i for i, h in enumerate(heads) if len(h) == len(a)), len(heads))
            heads += [a] if k == len(heads) else []
            labels.append(k)
        sig = r["signals"]
        assert set(sig) == set(registry.NAMES) and len(sig) == 26
        assert sig["semantic_entropy"] == pytest.approx(entropy([labels.count(k) for k in set(labels)])) and sig["num_semantic_clusters"] == len(heads)
        mass = [sum(math.exp(p) for (_, p), k in zip(s, labels, strict=True) if k == c) for c in set(labels)]
        assert sig["weighted_semantic_entropy"] == pytest.approx(entropy(mass), abs=1e-9)
        assert sig["mean_entropy"] == pytest.approx(sum(g["entropy"]) / len(g["entropy"])) and sig["seq_prob"] == pytest.approx(math.exp(sum(g["chosen_log_probability"])))
        if r["answer_span"]:
            a, b = r["answer_span"]
            assert sig["answer_max_entropy"] == pytest.approx(max(g["entropy"][a:b])) and g["text"][:a].count("####") >= 1
        else:
            assert math.isnan(sig["answer_max_entropy"])
        reply = re.search(r"\d{1,3}", replies[r["example_id"]]["text"]) if r["example_id"] in replies else None
        want = int(reply.group()) / 100 if reply and int(reply.group()) <= 100 else math.nan
        assert sig["verbalized_confidence"] == pytest.approx(want, nan_ok=True)
    assert QUERIES["record_assembly"](spark, SF).count() == len(rows)


def test_jsonl_round_trip(spark, made, tmp_path):
    path = files.records_path(str(tmp_path), "gsm8k")
    files.save_records(made, path)
    back = files.records_for_task(spark, str(tmp_path), "gsm8k")
    key = lambda df: sorted(map(repr, df.select("example_id", "greedy_correct", "answer_span", "sample_texts", F.transform_values("signals", lambda k, v: F.round(v, 9)).alias("s")).collect()))
    assert key(back) == key(made)
    plain = tmp_path / "plain.jsonl"
    plain.write_text('\n{"example_id": "a", "task": "gsm8k", "greedy_correct": true, "signals": {"mean_entropy": NaN, "max_entropy": Infinity}}\n\n{"example_id": "b", "task": "gsm8k", "greedy_correct": false}\n')
    rows = files.load_records(spark, str(plain)).orderBy("example_id").collect()
    assert [r["example_id"] for r in rows] == ["a", "b"] and math.isnan(rows[0]["signals"]["mean_entropy"]) and rows[0]["signals"]["max_entropy"] == math.inf
    with pytest.raises(FileNotFoundError):
        files.load_records(spark, str(tmp_path / "none.jsonl"))


def test_streams_restart(spark, tmp_path):
    source, out, at = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()
    put = lambda i: (source / f"{i}.json").write_text("".join(json.dumps({"example_id": f"{i}-{k}", "task": "gsm8k" if k % 2 else "nq_open", "greedy_correct": k < 2}) + "\n" for k in range(4)))
    put(0)
    streams.append_records(streams.stream_records(spark, str(source)), str(out), str(at)).awaitTermination()
    put(1)
    streams.append_records(streams.stream_records(spark, str(source)), str(out), str(at)).awaitTermination()
    assert sorted(r["example_id"] for r in files.load_records(spark, str(out)).collect()) == [f"{i}-{k}" for i in range(2) for k in range(4)]
    query = streams.running_accuracy(streams.stream_records(spark, str(source))).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["task"]: (r["n"], r["accuracy"]) for r in spark.table("running").collect()} == {"gsm8k": (4, 0.5), "nq_open": (4, 0.5)}


def test_wide_vocabulary_is_linear(spark):
    import time

    rows = spark.range(400).select(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.sin(i.cast("double") + F.col("id")) * 3).alias("z"))
    began = time.time()
    found = rows.select(steps.step_statistics(F.col("z")).alias("s"), "z").limit(400).collect()
    assert time.time() - began < 60
    z = found[0]["z"]
    total = math.log(sum(math.exp(x) for x in z))
    p = sorted((math.exp(x - total) for x in z), reverse=True)
    assert found[0]["s"]["entropy"] == pytest.approx(-sum(x * math.log(x) for x in p)) and found[0]["s"]["margin"] == pytest.approx(p[0] - p[1])


def test_small_helpers(spark):
    one = spark.range(1)
    span = F.struct(F.lit(1).alias("start"), F.lit(9).alias("end"))
    values = F.array(*map(F.lit, (1.0, 2.0, 3.0)))
    r = one.select(
        steps.slice_to_span(values, span).alias("a"), steps.slice_to_span(values, F.lit(None).cast("struct<start:int,end:int>")).alias("b"), steps.effective_length(F.array(*map(F.lit, (5, 7, 2, 7))), F.array(F.lit(2))).alias("c"),
        steps.shannon_entropy(F.array(F.lit(2.0), F.lit(2.0))).alias("d"), steps.shannon_entropy(F.array().cast("array<double>")).alias("e"), text.decimals(F.lit(0.12345)).alias("f"), text.percent(F.lit(0.256), 1).alias("g"), text.decimals(F.lit(math.nan)).alias("h"),
        steps.mean_log_probability(F.array(F.lit(-1.0), F.lit(-2.0))).alias("i"), steps.mean_log_probability(F.array().cast("array<double>")).alias("j"),
    ).first()
    assert r["a"] == [2.0, 3.0] and r["b"] == [1.0, 2.0, 3.0] and r["c"] == 3 and r["d"] == pytest.approx(math.log(2)) and math.isnan(r["e"])
    assert (r["f"], r["g"], r["h"]) == ("0.123", "25.6%", "—") and r["i"] == -1.5 and math.isnan(r["j"])
    assert inference.entailment_index({0: "contradiction", 2: "ENTAILMENT"}) == 2


def test_errors(spark):
    rows = spark.createDataFrame([("t", "a", 0.5, True)], "task string, example_id string, conf double, ok boolean")
    for wrong in (lambda: metrics.edges("quantile", rows, ["task"], "conf"), lambda: metrics.bootstrap(rows.withColumnRenamed("conf", "u").withColumn("pos", F.lit("a")), ["task"], mode="other"), lambda: files.load_task("other", rows, 1, 1), lambda: split.dev_test_split(rows, fraction=1.0)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(KeyError):
        registry.orientation("no such signal")
    with pytest.raises(KeyError):
        signals.signal_map({"no such signal": F.lit(1.0)})
    with pytest.raises(RuntimeError):
        inference.entailment_index({0: "neutral"})
    with pytest.raises(Exception, match="unknown task"):
        spark.range(1).select(text.canonical_answer(F.lit("other"), F.lit("x"))).collect()
    assert reports.tier_verdict(decisions.tier_separation(spark.createDataFrame([], "task string, tier string, n long, accuracy double"), ["task"])).count() == 0
