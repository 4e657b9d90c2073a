"""The model boundary: text generation and entailment as pluggable functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENERATION = "example_id string, sample_idx int, text string, token_ids array<int>, entropy array<double>, max_probability array<double>, margin array<double>, chosen_log_probability array<double>"


def generate(prompts: DataFrame, generator: Callable[[pd.DataFrame], pd.DataFrame], samples: int = 1) -> DataFrame:
    """Generations of prompts(example_id, prompt): `generator` gets a batch with column `samples` and returns the
    columns of GENERATION. It is shipped to the tasks, where it may load a model once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield generator(batch.assign(samples=samples))

    return prompts.select("example_id", "prompt").mapInPandas(run, GENERATION)


def exploded_steps(generations: DataFrame) -> DataFrame:
    """steps(seq_id, step, entropy, max_probability, margin, chosen_log_probability); arrays of unequal length are
    cut to the shortest."""
    fields = ("entropy", "max_probability", "margin", "chosen_log_probability")
    n = F.least(*[F.size(f) for f in fields])
    zipped = F.arrays_zip(*[F.slice(f, F.lit(1), n).alias(f) for f in fields])
    return generations.select(F.concat_ws("/", "example_id", "sample_idx").alias("seq_id"), F.posexplode(zipped).alias("step", "z")).select("seq_id", "step", *[F.col(f"z.{f}").alias(f) for f in fields])


def entailment_index(labels: dict[int, str], name: str = "entailment") -> int:
    """The place of the entailment class among a model's labels, whatever their case."""
    found = [i for i, label in labels.items() if label.lower() == name]
    if not found:
        raise RuntimeError(f"the model has no class {name}: {labels}")
    return int(found[0])


def entailment(predict: Callable[[list[tuple[str, str]]], list[bool]], size: int = 32) -> Callable[[Column, Column], Column]:
    """A vectorised (premise, hypothesis) -> boolean column of a batch predictor; clusters by it are
    operators.samples.model_clusters()."""

    @F.pandas_udf(T.BooleanType())
    def decide(premise: pd.Series, hypothesis: pd.Series) -> pd.Series:
        pairs, out = list(zip(premise, hypothesis, strict=True)), []
        for i in range(0, len(pairs), size):
            out += predict(pairs[i : i + size])
        return pd.Series(out)

    return decide


def bidirectional(decide: Callable[[Column, Column], Column], question: Column) -> Callable[[Column, Column], Column]:
    """Both directions of entailment between two answers to a question."""
    asked = lambda a: F.concat_ws(" ", question, a)
    return lambda a, b: decide(asked(a), asked(b)) & decide(asked(b), asked(a))
