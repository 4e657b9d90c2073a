"""Keyed states over record streams: the accuracy at every so many records, and the seeded take. Both need the RocksDB state
store (session.DEFAULTS names it) and go on where they were after a restart."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _needs_rocks(df: DataFrame) -> None:
    if not df.sparkSession.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set {STORE} to {ROCKS}")


class _EveryTenth(StatefulProcessor):
    def __init__(self, every: int, total: int | None) -> None:
        self.every, self.total = every, total

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("so_far", "n long, right long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, right = self.state.get() if self.state.exists() else (0, 0)
        new, out = pd.concat(list(rows)).sort_values("at", kind="stable")["good"], []
        for ok in new:
            n, right = n + 1, right + bool(ok)
            if n % self.every == 0 or n == self.total:
                out.append((key[0], n, right / n))
        self.state.update((n, right))
        yield pd.DataFrame(out, columns=["task", "n", "accuracy"])

    def close(self) -> None:
        """Nothing is held beside the state."""


def accuracy_log(stream: DataFrame, every: int = 10, total: int | None = None, ok: str = "greedy_correct", order: str = "example_id") -> DataFrame:
    """task, n, accuracy: a row at each `every`-th record of a task, and at the last one where their number is given. Records of one
    batch are taken in the order of `order`; a missing verdict counts as wrong. A task's records pass through its one state,
    two columns of them; what is due earlier than `every` is kept for the next batch."""
    _needs_rocks(stream)
    rows = stream.select("task", F.col(order).alias("at"), F.coalesce(F.col(ok), F.lit(False)).alias("good"))
    return rows.groupBy("task").transformWithStateInPandas(_EveryTenth(every, total), "task string, n long, accuracy double", "Append", "None")



class _Least(StatefulProcessor):
    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("least", "held string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in json.loads(self.state.get()[0])] if self.state.exists() else []
        for some in rows:
            held = heapq.nsmallest(self.n, dict.fromkeys([*held, *zip(some["place_of"], some["key_of"], some["row_of"], strict=True)]))
        self.state.update((json.dumps(held),))
        yield pd.DataFrame({"place": range(len(held)), "row": [r for *_, r in held]})

    def close(self) -> None:
        """Nothing is held beside the state."""


def stream_take(stream: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """place, row (JSON): the n rows that come first in the order of a seeded hash of the key, as sources.records.seeded_take()
    has them of a table, so far (update mode: each batch gives all places anew). Every task passes on n rows of a batch at most, so that the state meets few; equal
    rows count once."""
    _needs_rocks(stream)
    rows = stream.select(F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string"))).alias("place_of"), F.col(key).cast("string").alias("key_of"), F.to_json(F.struct(*stream.columns)).alias("row_of"))

    def least(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for some in batches:
            held = heapq.nsmallest(n, dict.fromkeys([*held, *some.itertuples(index=False, name=None)]))
        yield pd.DataFrame(held, columns=["place_of", "key_of", "row_of"])

    few = rows.mapInPandas(least, "place_of string, key_of string, row_of string").withColumn("whole", F.lit(0))
    return few.groupBy("whole").transformWithStateInPandas(_Least(n), "place int, row string", "Update", "None")
