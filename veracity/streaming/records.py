"""Record streams: incremental reading and writing of JSONL, running accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.records import RECORD


def stream_records(spark: SparkSession, folder: str, schema: str = RECORD, files_per_batch: int = 1) -> DataFrame:
    """New JSONL files of a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def append_records(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a folder of JSONL files, exactly once; ends with the available input."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_accuracy(stream: DataFrame, ok: str = "greedy_correct") -> DataFrame:
    """Rows and mean correctness so far, by task (complete mode)."""
    return stream.groupBy("task").agg(F.count("*").alias("n"), F.avg(F.col(ok).cast("double")).alias("accuracy"))
