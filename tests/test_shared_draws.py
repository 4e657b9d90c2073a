"""All figures of a signal come from one set of draws."""

from veracity.operators import analysis, metrics
from veracity.plans import reliability


def test_figures_share_draws(spark, monkeypatch):
    asked, whole = [], metrics.bootstrap
    monkeypatch.setattr(analysis.metrics, "bootstrap", lambda *args, metric, **options: asked.append(metric) or whole(*args, metric=metric, **options))
    reliability.evaluations(spark, "/root/testdata/sf0.001")
    assert asked == [("auroc", "aurc")]
