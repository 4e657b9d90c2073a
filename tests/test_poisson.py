"""Poisson counts: by blocks of a group's rows, each hashed with each replicate within its task."""

import hashlib
import random

import pytest

from veracity.operators import metrics, resample

ROWS = "g string, u double, ok boolean, pos string"


def test_rows_are_not_multiplied_by_replicates(spark):
    rows = spark.createDataFrame([("a", 1.0, True, "00f"), ("a", 2.0, False, "10e")], ROWS)
    plan = metrics.bootstrap(rows, ["g"], replicates=5, mode="poisson")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_blocks_add_up(spark, monkeypatch):
    """Many small blocks give what one gives; values that fill several of them and places of any length (or none) included."""
    rnd = random.Random(3)
    rows = [("a", float(rnd.choice([1, 1, 1, 2, 5, i])), rnd.random() < 0.6, hashlib.md5(str(i).encode()).hexdigest() * (1 + i % 2) if i else None) for i in range(300)]
    rows += [("zeros", z, ok, f"{i}") for i, (z, ok) in enumerate([(0.0, True), (-0.0, False), (-0.0, True), (1.0, None)])] + [("one class", 1.0, True, "x")]
    df = spark.createDataFrame([*rows, ("a", float("nan"), True, "x"), ("none", None, True, "y")], ROWS)
    found = lambda: sorted(map(str, metrics.bootstrap(df, ["g"], replicates=40, mode="poisson").collect()))
    whole = found()
    monkeypatch.setattr(resample, "PART", 7)
    assert found() == whole and len(whole) == 3


@pytest.mark.parametrize("size", [1, 20, 47, 48, 120])
def test_hashes(size):
    heads, tails = [b"42-100", b"42-999"], [bytes([65 + i]) * size + b"!" for i in range(3)]
    assert resample.md5_numbers(heads, tails).tolist() == [[int(hashlib.md5(h + t).hexdigest()[:8], 16) for t in tails] for h in heads]
