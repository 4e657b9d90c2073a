"""Record files and question sets: JSONL in and out, seeded takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = (
    "example_id STRING, task STRING, question STRING, gold_answers ARRAY<STRING>, metadata MAP<STRING,BIGINT>, "
    "greedy_text STRING, greedy_num_tokens INT, greedy_correct BOOLEAN, greedy_canonical STRING, answer_span ARRAY<INT>, "
    "sample_texts ARRAY<STRING>, sample_canonical ARRAY<STRING>, majority_answer STRING, majority_correct BOOLEAN, "
    "sample_correct ARRAY<BOOLEAN>, signals MAP<STRING,DOUBLE>, "
    "timings STRUCT<greedy_seconds:DOUBLE, sampling_seconds:DOUBLE, clustering_seconds:DOUBLE, verbalized_seconds:DOUBLE>"
)


def records_path(folder: str, task: str) -> str:
    return f"{folder}/records_{task}.jsonl"


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSONL file or folder of such; bare NaN and Infinity are read, empty lines skipped."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(f"no records at {path}: write them first with save_records()")
    return spark.read.schema(RECORD).json(path).where(F.col("example_id").isNotNull())


def records_for_task(spark: SparkSession, folder: str, task: str) -> DataFrame:
    return load_records(spark, records_path(folder, task))


def save_records(records: DataFrame, path: str) -> None:
    """Numbers that aren't finite are written quoted, which load_records() reads back."""
    records.write.mode("overwrite").json(path)


def save_metrics(analysis: DataFrame, path: str) -> None:
    """The nested result (a row a task) as JSON."""
    analysis.write.mode("overwrite").json(path)


def seeded_take(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows in the order of a seeded hash (a top-n: tasks keep n rows each, none sorts all)."""
    return rows.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def _numbered(rows: DataFrame, task: str, key: str, seed: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string"))), key)
    return rows.withColumn("example_id", F.format_string(f"{task}-%05d", F.row_number().over(order) - 1)).withColumn("task", F.lit(task))


def load_nq_open(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Examples of rows(key, question, answer array): numbered in taken order, then those without an alias go."""
    taken = _numbered(seeded_take(rows, n, "key", seed), "nq_open", "key", seed)
    return taken.where(F.size("answer") > 0).select("example_id", "task", F.trim("question").alias("question"), F.col("answer").alias("gold_answers"), F.create_map(F.lit("num_aliases"), F.size("answer").cast("long")).alias("metadata"))


def load_gsm8k(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Examples of rows(key, question, answer string): the solution is the one gold answer."""
    taken = _numbered(seeded_take(rows, n, "key", seed), "gsm8k", "key", seed)
    steps = F.length("answer") - F.length(F.replace("answer", F.lit("\n"), F.lit(""))) + 1
    return taken.select("example_id", "task", F.trim("question").alias("question"), F.array("answer").alias("gold_answers"), F.create_map(F.lit("solution_steps"), steps.cast("long")).alias("metadata"))


LOADERS = {"nq_open": load_nq_open, "gsm8k": load_gsm8k}


def load_task(task: str, rows: DataFrame, n: int, seed: int) -> DataFrame:
    if task not in LOADERS:
        raise ValueError(f"unknown task: {task}")
    return LOADERS[task](rows, n, seed)
