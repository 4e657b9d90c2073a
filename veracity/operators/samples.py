"""Sample-level uncertainty: samples(prompt_id, sample_idx, answer, logp) to rows per prompt. Counts per
(prompt, answer) are taken first, so that no step holds a prompt's samples together, but for greedy
clustering, which depends on their order and sees distinct answers only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.steps import once
from ..session import checkpointed

NAN = float("nan")
LEAST = 1e-12


def entropy_of_counts(samples: DataFrame, label: str, key: str = "prompt_id") -> DataFrame:
    """entropy, consistency (share of the most frequent) and distinct count of a label, by prompt."""
    counts = samples.groupBy(key, label).agg(F.count("*").cast("double").alias("n"))
    # Entropy from sums alone: ln(T) - sum(n ln n) / T; no second look at the counts.
    total = F.sum("n")
    return counts.groupBy(key).agg(
        F.greatest(F.log(total) - F.sum(F.col("n") * F.log("n")) / total, F.lit(0.0)).alias("entropy"),
        (F.max("n") / total).alias("consistency"),
        F.count("*").alias("distinct"),
    )


def weighted_entropy(samples: DataFrame, label: str, logp: str = "logp", key: str = "prompt_id") -> DataFrame:
    """Entropy of the labels' likelihood masses, by log-sum-exp shifted by each prompt's maximum; NaN if
    a log-likelihood isn't finite."""
    bad = F.col(logp).isNull() | F.isnan(logp) | (F.abs(logp) == float("inf"))
    top = samples.groupBy(key).agg(F.max(logp).alias("top"), F.max(bad).alias("bad"))
    mass = samples.join(top, key).groupBy(key, label).agg(F.sum(F.when(F.col("bad"), F.lit(0.0)).otherwise(F.exp(F.col(logp) - F.col("top")))).alias("m"), F.max("bad").alias("bad"))
    total = F.sum("m")
    return mass.groupBy(key).agg(F.when(F.max("bad") | (total <= LEAST), F.lit(NAN)).otherwise(F.greatest(F.log(total) - F.sum(F.when(F.col("m") > 0, F.col("m") * F.log("m")).otherwise(0.0)) / total, F.lit(0.0))).alias("weighted_entropy"))


def majority_answer(samples: DataFrame, answer: str = "answer", key: str = "prompt_id", index: str = "sample_idx") -> DataFrame:
    """The most frequent non-empty answer, first seen on ties; empty if there is none."""
    counts = samples.groupBy(key, answer).agg(F.count("*").alias("n"), F.min(index).alias("first"))
    full = F.col(answer) != ""
    best = F.max(F.when(full, F.struct("n", (-F.col("first")).alias("f"), F.col(answer).alias("a"))))
    return counts.groupBy(key).agg(F.coalesce(best["a"], F.lit("")).alias("majority_answer"), F.coalesce(best["n"], F.lit(0)).alias("votes"))


def sample_agreement(samples: DataFrame, answer: str = "answer", key: str = "prompt_id") -> DataFrame:
    """Share of samples equal to the majority answer: the largest count of an answer, or without any the count of empty ones."""
    counts = samples.groupBy(key, answer).agg(F.count("*").alias("n"))
    most, empty = F.max(F.when(F.col(answer) != "", F.col("n"))), F.max(F.when(F.col(answer) == "", F.col("n")))
    return counts.groupBy(key).agg((F.coalesce(most, empty, F.lit(0)) / F.sum("n")).alias("agreement"))


def cluster_labels(answers: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Greedy clusters of an array: each answer joins the first cluster whose first member it equals under
    `same`, or begins one. Equal strings are compared once."""
    start = F.struct(F.slice(answers, 1, 0).alias("reps"), F.array().cast("array<int>").alias("labels"))

    def step(state: Column, x: Column) -> Column:
        hit = F.array_position(F.transform(state["reps"], lambda r: F.coalesce(same(x, r), F.lit(False))), F.lit(True))
        label = F.when(hit > 0, hit - 1).otherwise(F.size(state["reps"])).cast("int")
        reps = F.when(hit > 0, state["reps"]).otherwise(F.concat(state["reps"], F.array(x)))
        return F.struct(reps.alias("reps"), F.concat(state["labels"], F.array(label)).alias("labels"))

    def placed(distinct: Column, labels: Column) -> Column:
        return F.transform(answers, lambda a: F.get(labels, (F.array_position(distinct, a) - 1).cast("int")))

    return once(F.array_distinct(answers), lambda d: once(F.aggregate(d, start, step)["labels"], lambda labels: placed(d, labels)))


def semantic_clusters(samples: DataFrame, same: Callable[[Column, Column], Column], answer: str = "answer", key: str = "prompt_id", index: str = "sample_idx") -> DataFrame:
    """samples with `label`. Only each prompt's distinct answers, in first-seen order, meet in an array: for prompts with a sample
    plan's dozens of answers. model_clusters() keeps answers as rows, however many a prompt has."""
    first = samples.groupBy(key, answer).agg(F.min(index).alias("first"))
    ordered = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", F.col(answer).alias("a")))), lambda x: x["a"]).alias("answers"))
    labels = ordered.select(key, F.explode(F.arrays_zip("answers", cluster_labels(F.col("answers"), same).alias("labels"))).alias("z")).select(key, F.col("z.answers").alias(answer), F.col("z.labels").alias("label"))
    return samples.join(labels, [key, answer])


def model_clusters(samples: DataFrame, same: Callable[[Column, Column], Column], carry: tuple[str, ...] = ("question",), answer: str = "answer", key: str = "prompt_id", index: str = "sample_idx") -> DataFrame:
    """semantic_clusters() for a `same` that a model decides (a Python UDF can't run inside an array's fold), and that may
    read the columns in `carry`, which are one value a prompt. Each round makes a prompt's first answer without a label the head of
    the next cluster and decides, in batches of rows, which of its other answers join it; there are as many rounds as the
    most clusters of a prompt. A null answer is a cluster of its own."""
    left = checkpointed(samples.groupBy(key, answer).agg(F.min(index).alias("_first"), *[F.first(c, ignorenulls=True).alias(c) for c in carry]))
    labels, label = None, 0
    while labels is None or not left.isEmpty():
        heads = left.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct("_first", answer)).alias("_head"))
        pairs = left.join(heads, F.col(key).eqNullSafe(F.col("_key")))
        pairs = pairs.select(*left.columns, F.col(f"_head.{answer}").alias("_rep"), F.struct("_first", answer).eqNullSafe(F.col("_head")).alias("_is_head"))
        asked = ~F.col("_is_head") & F.col(answer).isNotNull() & F.col("_rep").isNotNull()
        decided = pairs.where(asked).withColumn("_same", F.coalesce(same(F.col(answer), F.col("_rep")), F.lit(False)))
        decided = checkpointed(decided.unionByName(pairs.where(~asked).withColumn("_same", F.col("_is_head"))))
        joined = decided.where("_same").select(F.col(key).alias("_key"), F.col(answer).alias("_answer"), F.lit(label).alias("label"))
        labels = joined if labels is None else labels.unionByName(joined)
        left, label = decided.where("not _same").select(*left.columns), label + 1
    return samples.join(labels, F.col(key).eqNullSafe(F.col("_key")) & F.col(answer).eqNullSafe(F.col("_answer"))).drop("_key", "_answer")


def sentence_uncertainty(labelled: DataFrame, answer: str = "answer", key: str = "prompt_id") -> DataFrame:
    """The seven sample signals of samples with labels and log-likelihoods."""
    text = entropy_of_counts(labelled, answer, key).toDF(key, "lexical_entropy", "self_consistency", "num_distinct_answers")
    meaning = entropy_of_counts(labelled, "label", key).toDF(key, "semantic_entropy", "semantic_self_consistency", "num_semantic_clusters")
    weighted = weighted_entropy(labelled, "label", key=key).withColumnRenamed("weighted_entropy", "weighted_semantic_entropy")
    return text.join(meaning, key).join(weighted, key)
