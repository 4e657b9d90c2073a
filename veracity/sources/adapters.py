"""Views of general tables in the shape of the engine's own: scored answers, signals, steps, samples.

The engine's own records come from a model run. These views stand in for them on any star schema with
documents, so that every operator can run (and be checked) on plain tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NAN = float("nan")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(text: Column, pattern: str) -> Column:
    """Characters of the text that the pattern matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, task, ok, chars and counts of each labelled document: stands for an answered example."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", F.length(text).cast("double").alias("n"), _without(text, " ").alias("spaces"), _without(text, r"[#*$%&|<>!?]").alias("symbols"),
        _without(text, "\n").alias("lines"), _without(text, "[0-9]").alias("digits"),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    task = F.when(F.col("doc_id") % 2 == 0, "nq_open").otherwise("gsm8k")
    return docs.join(labels, "doc_id").withColumn("task", task)


def doc_values() -> dict[str, Column]:
    """Statistics of scored_docs() under registry names, of both orientations; seq_prob never varies
    and verbalized_confidence is never there; every fifth document lacks an answer span."""
    c, one = F.col, F.lit(1.0)
    size = F.greatest(c("n"), one)
    span = lambda x: F.when(c("doc_id") % 5 == 0, F.lit(NAN)).otherwise(x)
    return {
        "mean_entropy": c("n_chars") / 1000,
        "max_entropy": c("symbols") / size,
        "log_perplexity": (c("doc_id") % 97) / 97,
        "mean_max_prob": one - c("symbols") / size,
        "min_margin": c("spaces") / size,
        "seq_prob": one,
        "answer_mean_entropy": span((c("n") % 101) / 100),
        "answer_max_entropy": span(2 * c("symbols") / size),
        "answer_min_margin": span(c("digits") / size),
        "semantic_entropy": 100 * c("lines") / (one + c("n")),
        "lexical_entropy": c("symbols"),
        "self_consistency": one / (one + c("symbols")),
        "num_distinct_answers": c("lines"),
        "verbalized_confidence": F.lit(NAN),
    }


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, logits, chosen: a softmax over each embedding's places."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq_id"), F.col("embedding").alias("logits"), F.col("label").alias("chosen"))


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, step, logits, chosen, span_start, span_end: an order is a sequence, a line item is a step; three
    orders of four have an answer span."""
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    values = F.array(F.col("l_quantity") / 10, F.col("l_discount") * 30, F.col("l_tax") * 30)
    has = F.col("l_orderkey") % 4 != 0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq_id"), (F.row_number().over(line) - 1).alias("step"), values.alias("logits"), (F.col("l_linenumber") % 3).alias("chosen"),
        F.when(has, 1).alias("span_start"), F.when(has, 3).alias("span_end"),
    )


def order_samples(spark: SparkSession, sf_dir: str, answer: str = "o_orderpriority") -> DataFrame:
    """prompt_id, sample_idx, answer, logp: a customer is a prompt, its orders are the samples. The order key is
    the index: it is unique and sorts, so nothing has to be numbered."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("prompt_id"), F.col("o_orderkey").alias("sample_idx"), F.col(answer).alias("answer"), (-F.col("o_totalprice") / 1e5).alias("logp"))


def user_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompt_id, sample_idx, answer, logp: a user is a prompt, events are samples; errors are empty answers."""
    answer = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("prompt_id"), F.col("event_id").alias("sample_idx"), answer.alias("answer"), (-F.col("value") / 100).alias("logp"))


def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, generation, gold: worked solutions with a marker that may be missing, empty, repeated, or be
    followed by a number with separators."""
    n, price = F.col("p_size"), F.format_number(F.col("p_retailprice"), 2)
    kind = F.col("p_partkey") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit("So "), F.col("p_name"), F.lit("s cost "), price, F.lit(".\n#### "), price))
        .when(kind == 1, F.concat(F.lit("It is "), n.cast("string"), F.lit(" and then "), price, F.lit(".")))
        .when(kind == 2, F.concat(F.lit("It is "), n.cast("string"), F.lit(" ####")))
        .when(kind == 3, F.concat(F.lit("#### 1 and again #### -"), n.cast("string"), F.lit(".0")))
        .when(kind == 4, F.lit("no idea"))
        .otherwise(F.concat(F.lit("#####"), price, F.lit(" (that is "), n.cast("string"), F.lit(" times)")))
    )
    gold = F.concat(F.lit("#### "), F.when(F.col("p_partkey") % 4 == 0, n.cast("string")).otherwise(price))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("generation"), gold.alias("gold"))


def alias_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, generation, aliases: short answers in several dresses."""
    name, kind = F.col("p_name"), F.col("p_partkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("The answer is The "), name, F.lit("!"))).when(kind == 1, F.concat(F.lit(" Answer: "), F.upper(name), F.lit("..\nmore"))).when(kind == 2, F.concat(F.lit("A: "), F.col("p_brand"))).otherwise(F.lit("..."))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("generation"), F.array(F.initcap(name), F.regexp_replace("p_brand", "#1$", "#2")).alias("aliases"))


def cascade_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prompt_id, task, u, greedy_ok, majority_ok: the first sample is the greedy answer, the most frequent one the
    majority's, and the customer's key decides which is right; u is the mean price."""
    from ..operators.samples import majority_answer

    rows = order_samples(spark, sf_dir, "o_orderstatus")
    gold = F.when(F.col("prompt_id") % 2 == 0, "F").otherwise("O")
    first = rows.groupBy("prompt_id").agg(F.min_by("answer", "sample_idx").alias("greedy"), F.round(F.avg("logp"), 9).alias("mean_logp"))
    both = first.join(majority_answer(rows), "prompt_id")
    return both.select("prompt_id", F.lit("gsm8k").alias("task"), (-F.col("mean_logp")).alias("u"), (F.col("greedy") == gold).alias("greedy_ok"), (F.col("majority_answer") == gold).alias("majority_ok"))


def part_generations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """examples, greedy, samples and replies in the shape of a model's output: a part is a question about its price, its greedy answer is the
    worked solution of number_text(), one character a token; three samples vary it."""
    base = number_text(spark, sf_dir).withColumn("example_id", F.format_string("gsm8k-%06d", "id"))
    examples = base.select("example_id", F.lit("gsm8k").alias("task"), F.concat(F.lit("What does "), "example_id", F.lit(" cost?")).alias("question"), F.array("gold").alias("gold_answers"), F.create_map(F.lit("solution_steps"), F.lit(1).cast("long")).alias("metadata"))
    places = F.sequence(F.lit(1), F.length("generation"))
    arrays = {"entropy": lambda i: (i % 7) / 7.0, "max_probability": lambda i: 1.0 / (1 + i % 5), "margin": lambda i: (i % 3) / 4.0, "chosen_log_probability": lambda i: -(i % 11) / 50.0}
    greedy = base.select("example_id", F.col("generation").alias("text"), F.split("generation", "").alias("pieces"), *[F.transform(places, f).alias(n) for n, f in arrays.items()])
    said = F.when(F.col("k") == 0, F.col("generation")).when(F.col("k") == 1, F.concat(F.lit("#### "), (F.col("id") % 4).cast("string"))).otherwise(F.concat(F.lit("It is "), (F.col("id") % 3 + 1).cast("string")))
    samples = base.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).select("example_id", F.col("k").alias("sample_idx"), said.alias("text"), F.array(-(F.col("id") % 13) / 10.0, -F.col("k") / 10.0).alias("chosen_log_probability"))
    replies = base.where("id % 5 <> 0").select("example_id", F.concat(F.lit("About "), (F.col("id") % 120).cast("string"), F.lit("%")).alias("text"))
    return examples, greedy, samples, replies


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, timings: each event is a record in which one stage took the event's value (in seconds); the others
    are missing."""
    field = {"view": "greedy_seconds", "click": "sampling_seconds", "purchase": "clustering_seconds", "signup": "verbalized_seconds"}
    of = lambda e: F.when(F.col("event_type") == e, F.col("value")).alias(field[e])
    task = F.when(F.col("user_id") % 2 == 0, "nq_open").otherwise("gsm8k")
    return table(spark, sf_dir, "events").select(task.alias("task"), F.struct(*[of(e) for e in field]).alias("timings"))
