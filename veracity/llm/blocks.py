"""Texts dealt in blocks, and sampled window fingerprints (shared by operators 2 and 8).

Documents are dealt to blocks by a hash of id and text, so that rows that share an id (or have none) are spread too. A
block's texts travel compressed, stay in the shared folder, and are read there by each later step without another shuffle
of text. What blocks and groups tell each other are rows of fixed kinds (a mark and its block, a context, a mask), which Spark
groups by key: their number follows the windows, whatever the number of blocks or partitions.

Windows of `win` neighbouring symbols are sampled by minimizers: the anchor of a window is its k-gram with the
smallest hash (leftmost on ties), so equal windows have equal anchors at equal places, and only
about 2 / (win - k + 2) of all places are anchors. A window whose anchor occurs in one
document only is itself unique to it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, U64, can_checkpoint, grams, mix, parallelism, small_batches, text_bytes

#: Text bytes gathered in a task before they are packed, and text bytes a block should not exceed.
PACK_BYTES, BLOCK_BYTES = 16 << 20, 16 << 20
_PLACE = U64((1 << 31) - 1)
#: Stands for a missing id: rows without one come after all others and count as one document.
NO_ID = (1 << 63) - 1
TEXTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def block_count(docs: DataFrame) -> int:
    """Two blocks for each shuffle partition, more if those would be too large."""
    return max(2 * parallelism(docs.sparkSession), -(-text_bytes(docs) // BLOCK_BYTES))


def settled(df: DataFrame, key: str) -> DataFrame:
    """df dealt by `key` and checkpointed so that Spark still knows how it is dealt (it forgets
    under adaptive execution, which is off for this one step): later groupings by `key` need no shuffle."""
    spark = df.sparkSession
    can_checkpoint(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.repartition(parallelism(spark), key).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def deal(docs: DataFrame, count: int, first: int = 0) -> DataFrame:
    """(blk, pack) of docs(doc_id, text), settled by block: blocks first .. first + count - 1."""
    return settled(packs_of(docs, count, first), "blk")


def packs_of(docs: DataFrame, count: int, first: int = 0, change: Callable[[str], str] | None = None) -> DataFrame:
    """(blk, pack) of docs(doc_id, text), several packs a block; the texts as `change` makes them."""
    small_batches(docs.sparkSession)
    rows = docs.select(id_of().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), block_of(count, first).alias("blk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).sort_by([("blk", "ascending"), ("doc_id", "ascending")])
            blk = rows["blk"].to_numpy()
            edges = np.concatenate(([0], np.flatnonzero(blk[1:] != blk[:-1]) + 1, [len(blk)]))
            packs = [pack(rows.slice(a, b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(blk[edges[:-1]], pa.int32()), pa.array(packs, pa.binary())], names=["blk", "pack"])

        for batch in batches:
            if batch.num_rows:
                if change:
                    batch = batch.set_column(1, "text", pa.array([change(t) for t in batch.column(1).to_pylist()], pa.string()))
                held.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return rows.mapInArrow(run, "blk int, pack binary")


def id_of(name: str = "doc_id"):
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def with_ids(result: DataFrame) -> DataFrame:
    """A result with missing ids put back."""
    return result.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def block_of(count: int, first: int = 0):
    """The block of a row of docs(doc_id, text)."""
    return (F.pmod(F.xxhash64(id_of(), F.coalesce("text", F.lit(""))), F.lit(count)) + first).cast("int")


#: What a block is told, as rows: `kind` says what the numbers are.
NOTES = "blk int, kind int, a long, b long, digest binary"
COPY, SHARED, MASK = 0, 1, 2
_NOTES = {"blk": pa.int32(), "kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "digest": pa.binary()}
MARKS = "mark long, blk int, variety int"


def noted(notes: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a block's notes of one kind."""
    chosen = notes.filter(pa.array(notes["kind"].to_numpy() == kind))
    return chosen["a"].to_numpy(), chosen["b"].to_numpy()


def note_rows(blk: np.ndarray, kind: int, a: np.ndarray, b: np.ndarray, packed=None) -> pa.Table:
    """Notes of two numbers, or of two numbers and bytes."""
    last = pa.nulls(len(blk), pa.binary()) if packed is None else pa.array(packed, pa.binary())
    return pa.table([pa.array(blk, pa.int32()), pa.array(np.full(len(blk), kind), pa.int32()), pa.array(a), pa.array(b), last], schema=pa.schema(_NOTES))


def mark_rows(blk: int, marks: np.ndarray, variety: np.ndarray) -> pa.Table:
    return pa.table([pa.array(marks.view(np.int64)), pa.array(np.full(len(marks), blk), pa.int32()), pa.array(variety, pa.int32())], names=["mark", "blk", "variety"])


def met(marks: DataFrame, hot: int, where: str = "true") -> DataFrame:
    """Notes (SHARED: a the mark, b whether it is hot) for the blocks of marks(mark, blk, variety) that share a mark with
    another block, or whose mark is hot: has `hot` different contexts or more in all. A block has one row a mark. `where` may use `at`,
    the largest block that has the mark."""
    by = Window.partitionBy("mark")
    seen = marks.select("mark", "blk", F.count("*").over(by).alias("n"), F.sum("variety").over(by).alias("v"), F.max("blk").over(by).alias("at"))
    return seen.where(f"(n > 1 or v >= {hot}) and ({where})").select("blk", F.lit(SHARED).alias("kind"), F.col("mark").alias("a"), F.expr(f"if(v >= {hot}, 1L, 0L)").alias("b"), F.lit(None).cast("binary").alias("digest"))


def bucketed(contexts: DataFrame, notes: DataFrame, windows: int, rows: int = 40_000) -> DataFrame:
    """contexts(key, ...) with `bucket`, a hash of the key: as many buckets as give about `rows` contexts each, judged by the notes
    that ask for them (a hot mark asks for `windows`)."""
    spark = contexts.sparkSession
    asked = notes.where(F.col("kind") == SHARED).agg(F.sum(1 + F.col("b") * (windows - 1))).first()[0] or 0
    return contexts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(max(parallelism(spark), -(-asked // rows)))))


def unpack(packs: pa.ChunkedArray) -> pa.Table:
    """The documents of a block, by id."""
    coder = zstandard.ZstdDecompressor()
    parts = [pa.ipc.open_stream(coder.decompress(p.as_py())).read_all() for p in packs]
    return pa.concat_tables(parts or [TEXTS.empty_table()]).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def merged(packs: pa.ChunkedArray) -> bytes:
    """The documents of a block as one pack."""
    return pack(unpack(packs))


def pack(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TEXTS) as out:
        out.write_table(rows.select(["doc_id", "text"]).combine_chunks().cast(TEXTS))
    return zstandard.compress(sink.getvalue(), 3)


@dataclass
class Anchors:
    """place: first symbol of the anchor's k-gram; low .. high: the windows that it is the anchor of,
    by first symbol; mark: hash of the k-gram; doc: index of the text."""

    place: np.ndarray
    low: np.ndarray
    high: np.ndarray
    mark: np.ndarray
    doc: np.ndarray

    def take(self, chosen: np.ndarray) -> Anchors:
        return Anchors(*(getattr(self, f)[chosen] for f in ("place", "low", "high", "mark", "doc")))


def sampled(codes: np.ndarray, offsets: np.ndarray, k: int, win: int) -> Anchors:
    """The anchors of all windows that lie within one text."""
    n = len(codes) - win + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return Anchors(none, none, none, np.zeros(0, np.uint64), none)
    mark = mix(grams(codes, k))
    low = (mark & ~_PLACE) | np.arange(len(mark), dtype=np.uint64)
    span, length = win - k + 1, 1
    while 2 * length <= span:
        low = np.minimum(low[:-length], low[length:])
        length *= 2
    if length < span:
        low = np.minimum(low[: n], low[span - length : span - length + n])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(doc[:n] == doc[win - 1 :])
    place = (low[start] & _PLACE).astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else none
    last = np.concatenate((edge[1:], [len(place)])) - 1 if len(place) else none
    place = place[edge]
    return Anchors(place, start[edge], start[last], mark[place], doc[start[edge]])


def sampled_in_slices(codes_of, offsets: np.ndarray, k: int, win: int, limit: int = SLICE_BYTES) -> Anchors:
    """sampled() over whole texts, about `limit` symbols at a time; codes_of(a, b) gives codes."""
    parts, first = [], 0
    while first < len(offsets) - 1:
        last = max(int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1, first + 1)
        part = sampled(codes_of(offsets[first], offsets[last]), offsets[first : last + 1] - offsets[first], k, win)
        at = offsets[first]
        parts.append(Anchors(part.place + at, part.low + at, part.high + at, part.mark, part.doc + first))
        first = last
    empty = sampled(np.zeros(0, np.uint64), np.zeros(1, np.int64), k, win)
    return Anchors(*(np.concatenate([getattr(p, f) for p in [empty, *parts]]) for f in ("place", "low", "high", "mark", "doc")))


def in_two_texts(marks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each anchor's mark occurs in texts of two ids or more of the block."""
    order = np.lexsort((ids, marks))
    m, d = marks[order], ids[order]
    first = np.concatenate(([True], m[1:] != m[:-1])) if len(m) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    differs = np.zeros(int(group[-1]) + 1 if len(m) else 0, bool)
    change = np.flatnonzero(~first[1:] & (d[1:] != d[:-1])) + 1 if len(m) else np.zeros(0, np.int64)
    differs[group[change]] = True
    out = np.zeros(len(m), bool)
    out[order] = differs[group] if len(m) else False
    return out


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in some window of `length` that begins at one of the starts."""
    own, edge = np.zeros(n + 1, bool), np.zeros(n + 1, np.int8)
    own[starts] = True
    place = np.flatnonzero(own)
    if len(place):
        apart = place[1:] > place[:-1] + length
        edge[place[np.concatenate(([True], apart))]] = 1
        edge[place[np.concatenate((apart, [True]))] + length] = -1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0
