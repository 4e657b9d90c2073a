"""One-pass clusters by a model: against the plain greedy loop, the calls counted, many prompts in a call."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veracity.operators import folds
from veracity.operators import samples as sm


def counting(same):
    calls = []

    def decide(asked):
        calls.append(list(asked))
        return [same(a, b) for _, a, b in asked]

    return decide, calls


def plain(answers, same):
    heads, labels = [], {}
    for a in dict.fromkeys(answers):
        hit = next((k for k, h in enumerate(heads) if a is not None and h is not None and same(h, a)), None)
        if hit is None:
            heads.append(a)
            hit = len(heads) - 1
        labels[a] = hit
    return [labels[a] for a in answers]


@pytest.mark.parametrize(
    ("answers", "meaning", "labels", "asked"),
    [
        (["paris", "london"], {"paris": "P", "london": "L"}, [0, 1], 1),
        (["a", "b", "c"], dict.fromkeys("abc", "x"), [0, 0, 0], 2),
        (["18"], {"18": "18"}, [0], 0),
        ([], {}, [], 0),
        (["a", "b", "c"], {k: k for k in "abc"}, [0, 1, 2], 3),
    ],
)
def test_calls(answers, meaning, labels, asked):
    """Distinct answers need a comparison with each first member, and no more."""
    decide, calls = counting(lambda a, b: meaning[a] == meaning[b])
    assert folds.folded([("q", answers)], decide) == [labels]
    assert sum(map(len, calls)) == asked


def test_many_prompts_share_calls():
    rnd = random.Random(1)
    near = lambda a, b: abs(int(a) - int(b)) <= 2
    prompts = [(f"q{i % 7}", list(dict.fromkeys(str(rnd.randint(0, 20)) for _ in range(10)))) for i in range(600)]
    decide, calls = counting(near)
    assert folds.folded(prompts, decide) == [plain(a, near) for _, a in prompts]
    every = [x for c in calls for x in c]
    assert len(every) == len(set(every))  # what was decided for a question isn't asked again
    assert len(calls) < 60  # not one for each of some 4,000 answers
    assert all(len({q for q, *_ in c}) > 1 for c in calls[:5])


def test_both_ways():
    seen = []

    def predict(pairs):
        seen.append(pairs)
        return [len(a) <= len(b) for a, b in pairs]

    assert folds.both_ways(predict, 2)([("q", "a", "b"), ("q", "aa", "b"), (None, "b", "c")]) == [True, False, True]
    assert [len(p) for p in seen] == [4, 2] and seen[0] == [("q a", "q b"), ("q aa", "q b"), ("q b", "q a"), ("q b", "q aa")] and seen[1][0] == ("b", "c")


@pytest.mark.parametrize("most", [512, 4])
def test_rows(spark, most):
    """Null keys, answers and questions, repeated answers; prompts above `most` take the rounds and get the same labels."""
    rnd = random.Random(2)
    rows = [(p, i, str(rnd.randint(0, 9)) if rnd.random() < 0.9 else None, f"q{p}") for p in [*range(12), None] for i in range(rnd.randint(1, 12))]
    df = spark.createDataFrame(rows, "prompt_id long, sample_idx int, answer string, question string").repartition(3)
    same = lambda a, b: abs(int(a) - int(b)) <= 1
    got = folds.fold_clusters(df, lambda asked: [abs(int(a) - int(b)) <= 1 for _, a, b in asked], most=most).select("prompt_id", "sample_idx", "label").collect()
    want = []
    for p in [*range(12), None]:
        mine = [(i, a) for q, i, a, _ in rows if q == p]
        want += [(p, i, k) for (i, _), k in zip(mine, plain([a for _, a in mine], same), strict=True)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert folds.fold_clusters(df.limit(0), lambda asked: []).count() == 0


def test_long_folds_of_expressions_are_quadratic_at_most(spark):
    """A prompt of many distinct answers: each is compared with the first members once, not once again for each answer."""
    took = []
    for n in (200, 400):
        df = spark.range(n).select(F.lit(1).alias("prompt_id"), F.col("id").alias("sample_idx"), F.col("id").cast("string").alias("answer"))
        began = time.time()
        assert sm.semantic_clusters(df, lambda a, b: a == b).agg(F.max("label")).first()[0] == n - 1
        took.append(time.time() - began)
    assert took[1] < 10
