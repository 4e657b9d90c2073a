"""What a task of the bootstrap holds."""

import numpy as np

from veracity.operators import metrics, resample


def test_metrics_see_few_replicates_at_once(spark):
    rows = spark.createDataFrame([("a", float(i), i % 3 > 0, f"{i:03}") for i in range(50)], "g string, u double, ok boolean, pos string")
    width = resample.Metric("width", 1, lambda p: np.full((len(p.counts), 1), float(len(p.counts))), lambda s: s[0])
    assert 1 <= metrics.bootstrap(rows, ["g"], metric=width).first()["upper"] <= 125


def test_step_tables_are_short():
    """What no number reaches takes no room: 4,096 entries of a cache once held whole distributions."""
    all_, steps = resample._steps(4000, 2000, 4000)
    assert 1500 < all_ < 2000 and len(steps) < 1000 and steps.nbytes < 4096


def test_a_tuple_of_metrics_gives_what_each_gives(spark):
    rows = spark.createDataFrame([(g, float(i * i % 17), i % 5 > 1, f"{i:03}") for g in "ab" for i in range(90)], "g string, u double, ok boolean, pos string")
    both = sorted(metrics.bootstrap(rows, ["g"], metric=("auroc", "aurc"), replicates=60).collect())
    each = [sorted(metrics.bootstrap(rows, ["g"], metric=m, replicates=60).collect()) for m in ("auroc", "aurc")]
    assert [tuple(r) for r in both] == [(x[0], *x[1:], *y[1:]) for x, y in zip(*each, strict=True)]
