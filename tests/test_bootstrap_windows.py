"""No window of the bootstrap's rows is by the group alone."""

import re

import pytest

from veracity.operators import metrics


@pytest.mark.parametrize(("mode", "metric"), [("multinomial", "auroc"), ("multinomial", "aurc"), ("poisson", "auroc")])
def test_rows_are_ordered_within_parts(spark, mode, metric):
    rows = spark.createDataFrame([("a", 1.0, True, "00f"), ("a", 2.0, False, "10e")], "g string, u double, ok boolean, pos string")
    plan = metrics.bootstrap(rows, ["g"], replicates=5, mode=mode, metric=metric)._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*\], \[(.*?)\], \[(.*?) ASC", plan)
    assert windows
    assert sum(order.startswith("u#") and "_r#" not in by for by, order in windows) <= 1  # the replicates' values
    assert not any(order.startswith("pos#") and "_p#" not in by and "_s#" not in by for by, order in windows)
