"""The record format: batch, stream and write side, byte ranges, growing files, restarts; and the keyed states over streams."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from veracity.sources import datasource
from veracity.sources import records as files
from veracity.streaming import states

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    datasource.register(spark)
    old = spark.conf.get(states.STORE)
    spark.conf.set(states.STORE, states.ROCKS)
    yield
    spark.conf.set(states.STORE, old)


def record(i, **more):
    return {"example_id": f"e{i:04}", "task": "gsm8k" if i % 2 else "nq_open", "greedy_correct": i % 3 == 0, "signals": {"mean_entropy": math.nan if i % 4 == 0 else i / 8, "max_entropy": -math.inf}, "answer_span": [1, i], "metadata": {"k": i}} | more


def lines(rows):
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows)


@pytest.mark.parametrize("split", [1, 37, 1 << 20])
def test_ranges(spark, tmp_path, split):
    """However a file is cut, each line is read once; empty lines, a last line without an end, null maps, unknown fields."""
    rows = [record(i, question="é ß" * (i % 5), other=1) for i in range(40)] + [{"example_id": "last", "signals": None}]
    (tmp_path / "a.jsonl").write_text("\n" + lines(rows).replace('"e0007"', '"e0007"', 1)[:-1])
    (tmp_path / "_b.jsonl").write_text("not read")
    (tmp_path / "c.txt").write_text("not read")
    got = spark.read.format("records").option("splitBytes", max(split, 20)).load(str(tmp_path)).collect() if split < 37 else spark.read.format("records").option("splitBytes", split).load(str(tmp_path / "a.jsonl")).collect()
    assert sorted(r["example_id"] for r in got) == sorted(r["example_id"] for r in rows)
    one = next(r for r in got if r["example_id"] == "e0004")
    assert math.isnan(one["signals"]["mean_entropy"]) and one["signals"]["max_entropy"] == -math.inf and one["metadata"] == {"k": 4} and one["answer_span"] == [1, 4] and one["question"] == "é ß" * 4
    assert next(r for r in got if r["example_id"] == "last")["signals"] is None


def test_write_and_read(spark, tmp_path):
    path = str(tmp_path / "out")
    made = spark.createDataFrame([tuple(record(i).values()) for i in range(30)], "example_id string, task string, greedy_correct boolean, signals map<string,double>, answer_span array<int>, metadata map<string,bigint>").repartition(4)
    made.write.format("records").mode("append").save(path)
    made.limit(5).write.format("records").mode("append").save(path)
    assert spark.read.format("records").load(path).count() == 35
    assert "NaN" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.jsonl"))  # bare, as json writes it
    assert files.load_records(spark, path).where("isnan(signals['mean_entropy'])").count() >= 8
    made.write.format("records").mode("overwrite").save(path)
    key = lambda df: sorted(map(repr, df.select(*made.columns).collect()))
    assert key(spark.read.format("records").load(path)) == key(made)
    with pytest.raises(Exception, match="no records"):
        spark.read.format("records").load(str(tmp_path / "none")).collect()
    broken = made.withColumn("task", F.when(F.col("example_id") == "e0003", F.raise_error(F.lit("stop"))).otherwise(F.col("task")))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("records").mode("overwrite").save(path)
    assert key(spark.read.format("records").load(path)) == key(made)  # what was there stays


def test_stream_follows_files(spark, tmp_path):
    """A file that grows, half a line at its end, and a new one; each record goes through once over three runs."""
    source, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    source.mkdir()

    def run():
        spark.readStream.format("records").load(str(source)).writeStream.format("records").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["example_id"] for r in spark.read.format("records").load(out).select("example_id").collect())

    whole = lines([record(i) for i in range(6)])
    (source / "a.jsonl").write_text(whole[: len(whole) - 10])
    assert run() == [f"e{i:04}" for i in range(5)]
    (source / "a.jsonl").write_text(whole)
    (source / "b.jsonl").write_text(lines([record(i) for i in range(6, 9)]))
    assert run() == [f"e{i:04}" for i in range(9)]
    assert run() == [f"e{i:04}" for i in range(9)]


def streamed(spark, made, at, name, mode):
    query = made.writeStream.outputMode(mode).format("parquet").option("path", f"{at}/{name}").option("checkpointLocation", f"{at}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination()


def test_accuracy_log_and_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    every, want = 10, {}
    for batch, (a, b) in enumerate(((0, 37), (37, 41), (41, 100))):
        (source / f"{batch}.jsonl").write_text(lines([record(i) for i in range(a, b)]))
        streamed(spark, states.accuracy_log(spark.readStream.format("records").load(str(source)), every, total=50), str(tmp_path), "log", "append")
    for task, odd in (("gsm8k", 1), ("nq_open", 0)):
        right = [i % 3 == 0 for i in range(100) if i % 2 == odd]
        want |= {(task, n): sum(right[:n]) / n for n in range(every, 51, every)}
    got = {(r["task"], r["n"]): r["accuracy"] for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got == pytest.approx(want) and spark.read.parquet(str(tmp_path / "log")).count() == len(want)


def test_stream_take(spark, tmp_path):
    """After each batch the take is that of all rows so far, whatever the cut into batches."""
    source, rnd = tmp_path / "in", random.Random(1)
    source.mkdir()
    ids = rnd.sample(range(1000), 60)
    taken = []

    def keep(batch, number):
        taken.append([json.loads(r["row"])["example_id"] for r in batch.orderBy("place").collect()])

    for batch in range(3):
        (source / f"{batch}.jsonl").write_text(lines([record(i) for i in ids[batch * 20 : batch * 20 + 20]]))
        made = states.stream_take(spark.readStream.format("records").load(str(source)).select("example_id", "task"), 7, "example_id", 42)
        made.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "take")).trigger(availableNow=True).start().awaitTermination()
        whole = spark.createDataFrame([(f"e{i:04}",) for i in ids[: batch * 20 + 20]], "example_id string")
        assert taken[-1] == [r["example_id"] for r in files.seeded_take(whole, 7, "example_id", 42).collect()]
    assert len(taken) == 3


def test_store_is_asked_for(spark, tmp_path):
    spark.conf.set(states.STORE, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            states.accuracy_log(spark.range(1).selectExpr("'t' AS task", "'a' AS example_id", "true AS greedy_correct"))
    finally:
        spark.conf.set(states.STORE, states.ROCKS)
