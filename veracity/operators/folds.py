"""Greedy clusters of answers by a model, in one pass: each prompt's fold is a coroutine that asks for pairs; a task runs many of
them side by side and puts what they ask into one call of the model."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .samples import model_clusters

#: (question, answer, answer) triples to whether both answers mean the same.
Decide = Callable[[list[tuple[str | None, str, str]]], list[bool]]
#: Prompts whose folds are open at once in a task; distinct answers up to which a prompt is folded in one row.
OPEN, MOST = 256, 512

Asked = list[tuple[str, str]]


def greedy(answers: list[str | None]) -> Generator[Asked, list[bool], list[int]]:
    """Labels of distinct answers: each joins the first cluster whose first member means the same, or begins one. Yields the pairs
    of an answer with all first members at once. A null answer is a cluster of its own."""
    heads: list[str | None] = []
    labels = []
    for answer in answers:
        asked = [(k, h) for k, h in enumerate(heads) if h is not None and answer is not None]
        same = (yield [(h, answer) for _, h in asked]) if asked else []
        hit = next((k for (k, _), yes in zip(asked, same, strict=True) if yes), None)
        if hit is None:
            hit = len(heads)
            heads.append(answer)
        labels.append(hit)
    return labels


def folded(prompts: list[tuple[str | None, list[str | None]]], decide: Decide) -> list[list[int]]:
    """Labels of (question, distinct answers) of many prompts. In each round the model gets, in one call, what all open
    folds ask; a pair that was asked for the same question before is remembered."""
    out: list[list[int]] = [[] for _ in prompts]
    known: dict[tuple[str | None, str, str], bool] = {}
    waiting = iter(range(len(prompts)))
    open_: dict[int, tuple[Generator, Asked]] = {}

    def advance(i: int, fold: Generator, reply: list[bool] | None) -> None:
        try:
            open_[i] = (fold, fold.send(reply))
        except StopIteration as end:
            out[i] = end.value
            open_.pop(i, None)

    while True:
        while len(open_) < OPEN and (i := next(waiting, None)) is not None:
            advance(i, greedy(prompts[i][1]), None)
        if not open_:
            return out
        new = list(dict.fromkeys((prompts[i][0], *pair) for i, (_, asked) in open_.items() for pair in asked if (prompts[i][0], *pair) not in known))
        if new:
            known.update(zip(new, map(bool, decide(new)), strict=True))
        for i, (fold, asked) in list(open_.items()):
            advance(i, fold, [known[prompts[i][0], *pair] for pair in asked])


def both_ways(predict: Callable[[list[tuple[str, str]]], list[bool]], size: int = 32) -> Decide:
    """Entailment in both directions, each answer behind its question; both directions go in one call of at most 2 * size pairs."""

    def decide(asked: list[tuple[str | None, str, str]]) -> list[bool]:
        out = []
        for a in range(0, len(asked), size):
            some = [(" ".join(filter(None, (q, x))), " ".join(filter(None, (q, y)))) for q, x, y in asked[a : a + size]]
            replies = predict(some + [(y, x) for x, y in some])
            out += [bool(there and back) for there, back in zip(replies[: len(some)], replies[len(some) :], strict=True)]
        return out

    return decide


def _in_rounds(decide: Decide, question: Column) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(T.BooleanType())
    def same(q: pd.Series, head: pd.Series, answer: pd.Series) -> pd.Series:
        return pd.Series(decide(list(zip(q, head, answer, strict=True))), dtype=bool)

    return lambda answer, head: same(question, head, answer)


def fold_clusters(samples: DataFrame, decide: Decide, question: str = "question", answer: str = "answer", key: str = "prompt_id", index: str = "sample_idx", most: int = MOST) -> DataFrame:
    """samples with `label`, the greedy clusters of each prompt's answers in the order of the index. Equal answers are
    asked for once. A prompt with more than `most` distinct answers keeps them as rows (samples.model_clusters), so that no task holds an
    unbounded prompt; the labels are the same."""
    by = F.col(key).eqNullSafe(F.col("_key"))
    first = samples.groupBy(key, answer).agg(F.min(index).alias("_first"), F.first(question, ignorenulls=True).alias("_question"))
    sizes = first.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    small = first.join(sizes.where(F.col("_n") <= most), by).groupBy(key).agg(F.max("_question").alias("_question"), F.array_sort(F.collect_list(F.struct("_first", F.col(answer).alias("a")))).alias("_answers"))
    schema = T.StructType([T.StructField("_key", samples.schema[key].dataType), T.StructField("_answer", samples.schema[answer].dataType), T.StructField("label", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [[x["a"] for x in row] for row in batch["_answers"].to_pylist()]
            labels = folded(list(zip(batch["_question"].to_pylist(), answers, strict=True)), decide)
            keys = batch[key].take(pa.array([i for i, row in enumerate(answers) for _ in row], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([a for row in answers for a in row], batch.schema.field("_answers").type.value_type.field("a").type), pa.array([v for row in labels for v in row], pa.int32())], ["_key", "_answer", "label"])

    out = samples.join(small.select(key, "_question", "_answers").mapInArrow(run, schema), by & F.col(answer).eqNullSafe(F.col("_answer"))).drop("_key", "_answer")
    large = sizes.where(F.col("_n") > most)
    if large.isEmpty():
        return out
    rest = samples.join(large, by, "left_semi")
    return out.unionByName(model_clusters(rest, _in_rounds(decide, F.col(question)), (question,), answer, key, index).select(*out.columns))
