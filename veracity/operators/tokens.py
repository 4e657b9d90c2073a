"""Token-level uncertainty: steps(seq_id, step, entropy, max_probability, margin, chosen_log_probability)
to one row per sequence, in one partial-plus-final aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import SPAN_PREFIX

NAN = float("nan")


def _summary(inside: Column | None, prefix: str) -> list[Column]:
    """The nine statistics and the count over the steps inside (all if None)."""
    pick = lambda c: F.col(c) if inside is None else F.when(inside, F.col(c))
    n = F.count(pick("entropy"))
    defined = lambda c: F.coalesce(c, F.lit(NAN))
    total = F.sum(pick("chosen_log_probability"))
    made = {
        "mean_entropy": F.avg(pick("entropy")), "max_entropy": F.max(pick("entropy")), "mean_max_prob": F.avg(pick("max_probability")),
        "min_max_prob": F.min(pick("max_probability")), "mean_margin": F.avg(pick("margin")), "min_margin": F.min(pick("margin")),
        "seq_log_prob": total, "seq_prob": F.exp(total), "log_perplexity": -total / n,
    }
    return [defined(F.when(n > 0, c)).alias(prefix + k) for k, c in made.items()] + [n.alias(prefix + "num_tokens")]


def token_uncertainty(steps: DataFrame, key: str = "seq_id") -> DataFrame:
    return steps.groupBy(key).agg(*_summary(None, ""))


def span_uncertainty(steps: DataFrame, key: str = "seq_id", start: str = "span_start", end: str = "span_end") -> DataFrame:
    """Full and answer-span statistics in one pass; without a span (null) the span is the whole."""
    inside = F.col(start).isNull() | ((F.col("step") >= F.col(start)) & (F.col("step") < F.col(end)))
    return steps.groupBy(key).agg(*_summary(None, ""), *_summary(inside, SPAN_PREFIX))


def trim_to_length(steps: DataFrame, lengths: DataFrame, key: str = "seq_id") -> DataFrame:
    """Steps before each sequence's effective length."""
    return steps.join(lengths.select(key, "effective_length"), key).where(F.col("step") < F.col("effective_length")).drop("effective_length")
