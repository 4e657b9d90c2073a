"""Records from generations: one row an example with its texts, scores, signals and timings. Per-step values stay arrays; the samples
of an example meet in one array at the end, a sample plan's dozen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import steps, text
from . import samples as sm
from .folds import Decide, fold_clusters
from .registry import COST_FIELDS, SPAN_PREFIX
from .signals import signal_map

NAN = float("nan")
STEP_FIELDS = ("entropy", "max_probability", "margin", "chosen_log_probability")
#: Tasks whose answer stands after a marker.
SPAN_TASKS = ("gsm8k",)
SAMPLE_SIGNALS = ("semantic_entropy", "weighted_semantic_entropy", "lexical_entropy", "self_consistency", "semantic_self_consistency", "num_semantic_clusters", "num_distinct_answers")


def array_summary(values: dict[str, Column], prefix: str = "") -> dict[str, Column]:
    """The nine token signals of a sequence's arrays, NaN where it has no step; see tokens.token_uncertainty() for steps as rows."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    n = F.size(values["entropy"])
    mean = lambda c: total(c) / n
    entropy, most, margin, chosen = (values[f] for f in STEP_FIELDS)
    made = {
        "mean_entropy": mean(entropy), "max_entropy": F.array_max(entropy), "log_perplexity": -mean(chosen), "mean_max_prob": mean(most), "min_max_prob": F.array_min(most),
        "mean_margin": mean(margin), "min_margin": F.array_min(margin), "seq_log_prob": total(chosen), "seq_prob": F.exp(total(chosen)),
    }
    return {prefix + k: F.when(n > 0, c).otherwise(NAN) for k, c in made.items()}


def canonical_samples(examples: DataFrame, samples: DataFrame) -> DataFrame:
    """samples(example_id, sample_idx, text, chosen_log_probability) with the question, `answer` in canonical form and `logp`."""
    rows = samples.join(examples.select("example_id", "task", "question"), "example_id")
    return rows.select("example_id", "sample_idx", "question", "text", text.canonical_answer(F.col("task"), F.col("text")).alias("answer"), steps.mean_log_probability(F.col("chosen_log_probability")).alias("logp"))


def assemble(examples: DataFrame, greedy: DataFrame, samples: DataFrame, replies: DataFrame | None, same: Callable[[Column, Column], Column] | None, model: bool = False, timings: DataFrame | None = None, decide: Decide | None = None) -> DataFrame:
    """Records (the columns of sources.records.RECORD) of

    - examples(example_id, task, question, gold_answers, metadata),
    - greedy(example_id, text, pieces, and an array for each of STEP_FIELDS), one generation each; pieces are the texts of its tokens,
    - samples(example_id, sample_idx, text, chosen_log_probability),
    - replies(example_id, text) to the question for confidence, or None where it isn't asked,
    - timings(example_id, timings), where measured.

    same decides whether two answers mean the same: an expression, or with model=True a function of a model
    (sources.inference.bidirectional); decide, if given, is a batch predicate that folds each example's answers in one pass
    (operators.folds). Examples without a greedy generation or a sample are left out; a step array is cut to the shortest."""
    answers = canonical_samples(examples, samples)
    if decide:
        clusters = fold_clusters(answers, decide, key="example_id")
    else:
        clusters = (sm.model_clusters if model else sm.semantic_clusters)(answers, same, key="example_id")
    meaning = sm.sentence_uncertainty(clusters, key="example_id")
    majority = sm.majority_answer(answers, key="example_id").select("example_id", "majority_answer")
    listed = answers.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "text", "answer"))).alias("s"))
    listed = listed.select("example_id", F.transform("s", lambda x: x["text"]).alias("sample_texts"), F.transform("s", lambda x: x["answer"]).alias("sample_canonical"))

    n = F.least(*[F.size(f) for f in STEP_FIELDS])
    first = greedy.select("example_id", F.col("text").alias("greedy_text"), "pieces", *[F.slice(f, F.lit(1), n).alias(f) for f in STEP_FIELDS])
    rows = examples.join(first, "example_id").join(listed, "example_id").join(majority, "example_id").join(meaning, "example_id")
    rows = rows.join(replies.select("example_id", F.col("text").alias("_reply")), "example_id", "left") if replies is not None else rows.withColumn("_reply", F.lit(None).cast("string"))
    names = [f for fields in COST_FIELDS.values() for f in fields]
    if timings is not None:
        rows = rows.join(timings.select("example_id", "timings"), "example_id", "left")
    else:
        rows = rows.withColumn("timings", F.struct(*[F.lit(None).cast("double").alias(f) for f in names]))
    rows = rows.withColumn("_span", F.when(F.col("task").isin(*SPAN_TASKS), steps.answer_span(F.col("pieces"))))
    # Without a span its signals are missing.
    inside = {f: F.when(F.col("_span").isNotNull(), steps.slice_to_span(F.col(f), F.col("_span"))) for f in STEP_FIELDS}
    values = array_summary({f: F.col(f) for f in STEP_FIELDS}) | array_summary(inside, SPAN_PREFIX) | {k: F.col(k) for k in SAMPLE_SIGNALS} | {"verbalized_confidence": text.verbalized_confidence(F.col("_reply"))}
    task, golds = F.col("task"), F.col("gold_answers")
    return rows.select(
        "example_id", "task", "question", "gold_answers", "metadata", "greedy_text", F.size("entropy").alias("greedy_num_tokens"),
        text.score_generation(task, F.col("greedy_text"), golds).alias("greedy_correct"), text.canonical_answer(task, F.col("greedy_text")).alias("greedy_canonical"),
        F.when(F.col("_span").isNotNull(), F.array("_span.start", "_span.end")).alias("answer_span"), "sample_texts", "sample_canonical", "majority_answer",
        text.score_canonical(task, F.col("majority_answer"), golds).alias("majority_correct"), F.transform("sample_canonical", lambda a: text.score_canonical(task, a, golds)).alias("sample_correct"),
        signal_map(values).alias("signals"), "timings",
    )
