"""Shared pieces of the corpus operators: table access, the shared folder, and vectorised
string kernels that turn an Arrow column of texts into flat byte / word arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled together inside one task, in bytes. One longer text is handled alone.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch sent to Python; keeps a batch of long texts small.
BATCH_ROWS = 1000

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
#: A random odd 64-bit code per byte value, and the base of the polynomial hashes.
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
BASE = U64(0x9E3779B97F4A7C15)
#: Bytes that separate words: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share. The setting is
    read from the session; only a local master (tests) may go without it and gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/veracity-{uuid.uuid4().hex}"


def can_checkpoint(spark: SparkSession) -> None:
    """Give the context a checkpoint folder if it has none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, counted."""
    return df.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the n + 1 offsets of the texts. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batch, *columns: str, limit: int = SLICE_BYTES):
    """Cut a batch into pieces of about `limit` bytes of its text columns together, whole rows only."""
    rows = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    lengths = sum(pc.fill_null(pc.binary_length(rows[c].cast(pa.large_binary())), 0).to_numpy() for c in columns or ("text",))
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield rows.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield rows.slice(start)


def piece_of(text: Column, hash_: Column, chars: int) -> Column:
    """The text, or `chars` characters from a place that a hash decides where it is longer: fits on samples read long texts
    too, each with a bounded piece from anywhere."""
    start = F.pmod(hash_, F.greatest(F.length(text) - chars + 1, F.lit(1)).cast("long")).cast("int") + 1
    return text.substr(start, F.lit(chars))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64-bit values evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, BASE, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k neighbouring codes, by doubling; len(codes) - k + 1 values."""
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        part, length, weight, out, done = codes, 1, BASE, None, 0
        while True:
            if k & length:
                if out is None:
                    out = part[: len(codes) - length + 1]
                else:
                    n = len(codes) - done - length + 1
                    out = out[:n] * weight + part[done : done + n]
                done += length
            if done == k:
                return out[: len(codes) - k + 1].copy()
            part = part[:-length] * weight + part[length:]
            weight, length = weight * weight, length * 2


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and text number of every word in the flat texts."""
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    inside = ~IS_SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = np.unique(offsets[(offsets > 0) & (offsets < len(raw))])
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offsets, start, "right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lengths = end - start
    index = np.repeat(start - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    column = index - np.repeat(start, lengths)
    with np.errstate(over="ignore"):
        values = BYTE_CODE[raw[index]] * powers(int(lengths.max()))[column]
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return mix(np.add.reduceat(values, firsts))


def per_text(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values (one per byte, or a boolean) over each text."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Words inside a 3-word window that its text has twice or more, for each text."""
    if len(hashes) < 3:
        return np.zeros(n, np.int64)
    key = grams(hashes, 3)
    own = doc[:-2] == doc[2:]
    place = np.flatnonzero(own)
    key, of = mix(key[place]), doc[:-2][place]
    order = np.lexsort((key, of))
    same = (key[order][1:] == key[order][:-1]) & (of[order][1:] == of[order][:-1])
    twice = np.zeros(len(place), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for shift in range(3):
        covered[place[twice] + shift] = True
    return np.bincount(doc[covered], minlength=n)
