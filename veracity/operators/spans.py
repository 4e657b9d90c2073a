"""The tokens that hold an answer, found through a decoder: texts of prefixes are asked for in batches, many generations at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Token lists to their texts.
Decode = Callable[[list[list[int]]], list[str]]
#: Generations whose searches go side by side; prefixes asked for at once in a whole scan.
TOGETHER, SCAN = 256, 64


def markers_needed(text: str, marker: str) -> int:
    """Occurrences (they may overlap) up to the last one that some digit follows; 0 if there is none."""
    places = [i for i in range(len(text)) if text.startswith(marker, i)]
    return max((k for k, i in enumerate(places, 1) if any(c.isdigit() for c in text[i + len(marker) :])), default=0)


def answer_spans(generations: list[list[int]], decode: Decode, marker: str, rising: bool = True) -> list[tuple[int, int] | None]:
    """(start, end) of each generation's answer: from the first prefix whose text holds the needed markers (apart, as str.count
    does), to the end. rising: longer prefixes hold no fewer markers, so the first one is found by halving, in one call of the decoder a
    round; otherwise all prefixes are tried from the shortest."""
    out: list[tuple[int, int] | None] = [None] * len(generations)
    texts = decode(generations) if generations else []
    needed = [markers_needed(t, marker) for t in texts]
    if rising:
        search = {i: (1, len(generations[i])) for i, k in enumerate(needed) if k and texts[i].count(marker) >= k}
        while search:
            middle = {i: (low + high) // 2 for i, (low, high) in search.items() if low < high}
            found = dict(zip(middle, decode([generations[i][:m] for i, m in middle.items()]), strict=True)) if middle else {}
            for i, (low, high) in list(search.items()):
                if low == high:
                    out[i] = (low, len(generations[i]))
                    del search[i]
                else:
                    m = middle[i]
                    search[i] = (low, m) if found[i].count(marker) >= needed[i] else (m + 1, high)
    else:
        for i, k in enumerate(needed):
            ids = generations[i]
            for a in range(1, len(ids) + 1 if k else 1, SCAN):
                prefixes = decode([ids[:m] for m in range(a, min(a + SCAN, len(ids) + 1))])
                hit = next((a + j for j, t in enumerate(prefixes) if t.count(marker) >= k), None)
                if hit:
                    out[i] = (hit, len(ids))
                    break
    return out


def with_answer_span(rows: DataFrame, decode: Decode, marker: str = "####", tokens: str = "token_ids", name: str = "answer_span", rising: bool = True) -> DataFrame:
    """rows with `name`, a struct(start, end) or null. Null tokens are an empty generation."""
    kind = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    kept = rows.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(start, TOGETHER)
                spans = answer_spans([ids or [] for ids in part[tokens].to_pylist()], decode, marker, rising)
                made = pa.array([s and {"start": s[0], "end": s[1]} for s in spans], pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, name])

    return kept.mapInArrow(run, schema)
