"""Clusters by an entailment model, with a stub for it, against the plain greedy loop."""

import random

from pyspark.sql import functions as F

from veracity.operators import samples as sm
from veracity.sources.inference import bidirectional, entailment


def stub():
    """A function of its own, so that it is shipped to the tasks by value."""

    def entails(premise: str, hypothesis: str) -> bool:
        """Not symmetric, not transitive, and another for each question."""
        (p, a), (q, b) = premise.split(" "), hypothesis.split(" ")
        assert p == q and p.startswith("q")
        return int(b) <= int(a) + 1 + int(p[1:]) % 3

    return entails


def test_clusters_of_a_model(spark):
    rnd = random.Random(3)
    rows = [(p, i, str(rnd.randint(0, 12)), -rnd.random(), f"q{p}") for p in range(9) for i in range(rnd.randint(1, 10))]
    rows += [(20, 0, None, -0.5, "q1"), (20, 1, "3", -0.5, "q1"), (20, 2, None, -0.5, "q1"), (None, 0, "4", -0.5, "q1"), (None, 1, "5", -0.5, "q1")]
    df = spark.createDataFrame(rows, "prompt_id long, sample_idx long, answer string, logp double, question string")

    entails = stub()
    predict = lambda pairs: [entails(*x) for x in pairs]
    labelled = sm.model_clusters(df, bidirectional(entailment(predict, 4), F.col("question"))).cache()
    heads: dict = {}
    want = []
    for p, i, a, _, q in rows:
        mine = heads.setdefault(p, [])
        both = lambda h: a is not None and h is not None and entails(f"{q} {a}", f"{q} {h}") and entails(f"{q} {h}", f"{q} {a}")  # noqa: B023, E731
        hit = next((k for k, h in enumerate(mine) if h == a or both(h)), None)
        if hit is None:
            mine.append(a)
        want.append((p, i, a, len(mine) - 1 if hit is None else hit))
    got = [tuple(r) for r in labelled.select("prompt_id", "sample_idx", "answer", "label").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    found = {r["prompt_id"]: r["num_semantic_clusters"] for r in sm.sentence_uncertainty(labelled.where("prompt_id < 20")).collect()}
    assert found == {p: len(heads[p]) for p in range(9)}
    assert sm.model_clusters(df.limit(0), bidirectional(entailment(predict), F.col("question"))).count() == 0
