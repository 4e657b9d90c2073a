"""Operator 13: whitening of embeddings by matrix-free block subspace iteration.

The k leading eigenvectors of the covariance, without the covariance: a pass computes Xᵀ(XQ) of the centred rows for a block Q of some columns, the
product is made orthonormal (QR) for the next pass, and Rayleigh-Ritz on QᵀXᵀXQ gives the pairs and, from the same pass, the residuals
‖V q - e q‖. Passes go on until the residuals of all k components are within TOLERANCE of the largest eigenvalue. The block has 2k columns to begin
with; where the residuals fall too slowly for PASSES more passes, it is doubled (at most the dimensions, where one pass settles all).

A row x is centred exactly as n x - S in integers, S the column sums. A task adds up its own rows; Spark adds the tasks' sums by groups of (dimension,
columns). The driver holds blocks of dimensions by columns, whatever the number of rows.

Cases: rows whose vector is null, empty or holds null or non-finite entries are left out; where lengths differ, the most frequent one counts (ties: the longer)
and other rows are left out; scaled entries beyond 2^53 stand at it; a deviation beyond a long is null; components whose eigenvalue is zero to
double precision (no variance, fewer rows or dimensions than k) can't be whitened and aren't returned; equal eigenvalues: any orthonormal vectors of their space; the entry of
largest size of a component is positive; repeated rows count each; a missing id stays missing; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, SCALE, SHIFT = 32, 64, 1_000_000
#: Largest scaled entry; residuals against the largest eigenvalue; passes after which a slow block is widened, and at most.
LARGEST, TOLERANCE, PASSES, MOST = 1 << 53, 1e-13, 4, 500
#: Rows handled at once; columns of the block in a row of partial sums.
ROWS, COLUMNS = 4096, 16
_WIDE = 1 << 62


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE c) + SHIFT of the entries, a row a vector."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    scaled = np.floor(np.asarray(pc.list_flatten(flat).to_numpy(zero_copy_only=False), float) * SCALE)
    return np.clip(scaled, -float(LARGEST), float(LARGEST)).astype(np.int64).reshape(-1, width) + SHIFT


@dataclass
class Centre:
    """Rows, dimensions and column sums of the fit list."""

    n: int
    sums: list[int]

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n x - S, in Python's integers where longs don't hold it."""
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums)) < _WIDE:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.exact(x) / self.n).astype(float)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        y = self.exact(x)
        if y.dtype != object and len(self.sums) * float(np.abs(y).max(initial=0)) ** 2 < _WIDE:
            return (y * y).sum(1).tolist()
        big = (y.astype(object) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in big]


def _usable(vectors: DataFrame) -> DataFrame:
    good = ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select("vec_id", "embedding").where(F.coalesce((F.size("embedding") > 0) & good, F.lit(False)))


def fit_list(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The usable rows of vectors(vec_id, embedding), and their length."""
    rows = _usable(vectors)
    length = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    width = length["length"] if length else 0
    return rows.where(F.size("embedding") == width), width


def _over(rows: DataFrame, made: Callable[[Iterator[np.ndarray]], Iterator[np.ndarray]], width: int) -> np.ndarray:
    """The sum over tasks of the matrices that `made` yields from the integer rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (integers(batch.slice(a, ROWS)["embedding"], width) for batch in batches for a in range(0, batch.num_rows, ROWS))
        total = None
        for matrix in made(parts):
            total = matrix if total is None else total + matrix
        if total is not None:
            padded = np.pad(total, ((0, 0), (0, -total.shape[1] % COLUMNS)))
            blocks = padded.shape[1] // COLUMNS
            flat = padded.reshape(-1, COLUMNS)
            keys = [pa.array(np.repeat(np.arange(len(total)), blocks), pa.int32()), pa.array(np.tile(np.arange(blocks), len(total)), pa.int32())]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(flat[:, j]) for j in range(COLUMNS)]], ["dim", "block", *[f"v{j}" for j in range(COLUMNS)]])

    schema = "dim int, block int, " + ", ".join(f"v{j} double" for j in range(COLUMNS))
    sums = rows.select("embedding").mapInArrow(run, schema).groupBy("dim", "block").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(COLUMNS)])
    got = {(r["dim"], r["block"]): r[2:] for r in sums.collect()}
    if not got:
        return np.zeros((0, 0))
    return np.array([np.concatenate([got[i, j] for j in range(max(b for _, b in got) + 1)]) for i in range(max(d for d, _ in got) + 1)])


def centre(rows: DataFrame, width: int) -> Centre:
    """Exact column sums of the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                x = integers(batch.slice(a, ROWS)["embedding"], width)
                low = x & 0xFFFFFFFF  # halves, whose sums over ROWS rows longs hold
                n, total = n + len(x), total + low.sum(0).astype(object) + (((x - low) >> 32).sum(0).astype(object) << 32)
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([n] * width), pa.array([str(int(t)) for t in total])], ["dim", "n", "total"])

    parts = rows.select("embedding").mapInArrow(run, "dim int, n bigint, total string")
    got = {r["dim"]: r for r in parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}
    return Centre(got[0]["n"] if got else 0, [int(got[i]["total"]) for i in range(width)] if got else [])


def covariance_times(rows: DataFrame, at: Centre, q: np.ndarray) -> tuple[np.ndarray, float]:
    """V Q and the trace of V, in one pass."""
    width = len(q)

    def made(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        for x in parts:
            y = at.centred(x)
            squares = np.zeros((width, 1))
            squares[:, 0] = (y * y).sum(0)
            yield np.hstack([y.T @ (y @ q), squares])

    total = _over(rows, made, width)[:, : q.shape[1] + 1] / at.n
    return total[:, :-1], float(total[:, -1].sum())


@dataclass
class Components:
    """Unit eigenvectors (columns) by falling eigenvalue, with what certifies them."""

    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int
    block: int


def components(rows: DataFrame, at: Centre, k: int = K, block: int | None = None, seed: int = 1) -> Components:
    """The k leading eigenpairs. block: columns to begin with (2k)."""
    width = len(at.sums)
    k, size, rng = min(k, width), min(width, block or 2 * k), np.random.default_rng(seed)
    q, before, since = np.linalg.qr(rng.normal(size=(width, size)))[0], np.inf, 0
    for done in range(1, MOST + 1):
        product, trace = covariance_times(rows, at, q)
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, image = q @ turn, product @ turn
        residuals = np.linalg.norm(image[:, :k] - vectors[:, :k] * values[:k], axis=0)
        worst = float(residuals.max()) / max(values[0], np.finfo(float).tiny)
        if worst <= TOLERANCE or values[0] <= 0 or size == width and since:  # over all dimensions only rounding is left
            break
        q, since = np.linalg.qr(image)[0], since + 1
        slow = since >= 2 and worst > TOLERANCE * max(before / max(worst, 1e-300), 1) ** PASSES  # at the last pass's pace
        before = worst
        if slow and size < width:
            wider = min(width, 2 * size)
            q = np.linalg.qr(np.hstack([q, rng.normal(size=(width, wider - size))]))[0]
            size, before, since = wider, np.inf, 0
    else:
        raise ArithmeticError(f"residual {worst:.1e} of the largest eigenvalue after {MOST} passes over a block of {size}")
    vectors = vectors[:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    return Components(vectors * sign, values[:k], residuals, trace, done, size)


def whiten(vectors: DataFrame, k: int = K) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of vectors(vec_id, embedding)."""
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows, width = fit_list(vectors)
    at = centre(rows, width) if width else Centre(0, [])
    found = components(rows, at, k) if at.n else None
    live = int((found.values > width * np.finfo(float).eps * found.trace).sum()) if found else 0
    if not live:
        return vectors.sparkSession.createDataFrame([], schema)
    turn = found.vectors[:, :live] / np.sqrt(found.values[:live])
    explained = found.values[:live] / found.trace

    def second_moments(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        for x in parts:  # the mean of whitened values is zero, as that of centred rows is
            w = at.centred(x) @ turn
            yield w.T @ w

    error = float(np.abs(_over(rows, second_moments, width)[:, :live] / at.n - np.eye(live)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x, m = integers(part["embedding"], width), part.num_rows
                repeat = pa.array(np.repeat(np.arange(m), live))
                columns = [part["vec_id"].take(repeat), pa.array(np.tile(np.arange(1, live + 1), m), pa.int32()), pa.array(np.full(m * live, at.n)), pa.array(at.deviation(x), pa.int64()).take(repeat)]
                columns += [pa.array((at.centred(x) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * live, error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
