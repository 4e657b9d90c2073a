"""Statistics of decoding steps from logits as they come. Rows are in the order of their steps; each row's distribution is reduced at
once, and only the last one of a task is kept until the next row tells which token was drawn from it. So a sequence's vocabulary axis
is never held, nor exploded."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Logits that are reduced at once.
CELLS = 1 << 21
_FIELDS = ("entropy", "max_probability", "margin", "chosen_log_probability")


def _matrix(logits: pa.Array) -> np.ndarray:
    """Rows of equal length; shorter ones are filled with -inf."""
    lengths = pc.fill_null(pc.list_value_length(logits), 0).to_numpy().astype(np.int64)
    out = np.full((len(logits), max(int(lengths.max(initial=0)), 1)), -np.inf)
    flat = pc.fill_null(pc.list_flatten(logits), np.nan).to_numpy(zero_copy_only=False).astype(float)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _reduced(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """entropy, max_probability and margin of the softmax of each row, and its log-probabilities."""
    top = z.max(1, keepdims=True)
    with np.errstate(all="ignore"):
        logs = z - (np.log(np.exp(z - top).sum(1, keepdims=True)) + top)
        p = np.exp(logs)
        entropy = -np.where(p > 0, p * logs, np.where(np.isnan(p), np.nan, 0.0)).sum(1)
    two = np.partition(p, -2, axis=1)[:, -2:] if z.shape[1] > 1 else np.c_[np.zeros(len(z)), p]
    return entropy, two[:, 1], two[:, 1] - two[:, 0], logs


def record_steps(blocks: DataFrame, ends: Iterable[int] = (), key: str = "seq_id") -> DataFrame:
    """key, step, token, entropy, max_probability, margin, chosen_log_probability of blocks(key, step, logits, input_token, final_token).

    The token drawn from a step's logits is the next row's input_token, or the row's own final_token where that is given (the last
    step). A row without an input token (a prompt) tells nothing of the step before it. Steps whose token isn't known are left out, as are those after
    a sequence's first token of `ends`. A token outside the vocabulary has no log-probability (null)."""
    stop = frozenset(ends)
    fields = [blocks.schema[key], T.StructField("step", T.IntegerType()), T.StructField("token", T.IntegerType()), *[T.StructField(f, T.DoubleType()) for f in _FIELDS]]
    rows = blocks.select(key, "step", "logits", "input_token", "final_token").repartition(key).sortWithinPartitions(key, "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, pending, ended = object(), None, False  # the key of the last row; its step, statistics and log-probabilities
        for batch in batches:
            widest = pc.max(pc.list_value_length(batch["logits"])).as_py() or 1
            size = max(1, CELLS // widest)
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                entropy, most, margin, logs = _reduced(_matrix(part["logits"]))
                keys, steps, inputs, finals = (part[c].to_pylist() for c in (key, "step", "input_token", "final_token"))
                out: list[tuple] = []

                def resolve(token: int) -> None:
                    nonlocal ended
                    k, step, h, p, m, log = pending  # noqa: B023
                    if not ended:
                        out.append((k, step, token, h, p, m, float(log[token]) if 0 <= token < len(log) and log[token] > -np.inf else None))  # noqa: B023
                    ended = ended or token in stop

                for i, k in enumerate(keys):
                    if k != before:
                        before, pending, ended = k, None, False
                    elif pending and inputs[i] is not None:
                        resolve(inputs[i])
                    pending = (k, steps[i], entropy[i], most[i], margin[i], logs[i])
                    if finals[i] is not None:
                        resolve(finals[i])
                        pending = None
                if pending:
                    pending = (*pending[:5], pending[5].copy())  # not the whole block's
                columns = list(zip(*out, strict=True)) or [()] * 7
                types = [part.schema.field(key).type, pa.int32(), pa.int32(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))
