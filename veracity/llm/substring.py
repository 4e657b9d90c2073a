"""Operator 8: incremental removal of repeated word windows with a log-structured fingerprint index.

A word goes if a window of WINDOW words that covers it also starts in a document with a smaller id,
in the same batch or in one added before. The index lies below one folder and outlives the session: sorted immutable
runs of the hashes of sampled windows (k words each, by minimizers, so that every WINDOW words hold one at a place that the words
alone decide), the texts of each batch in blocks, and a manifest of what counts. Adding a batch:

1. the batch's hashes become a new run: rows (mark, block), dealt and sorted by mark;
2. each older run is merge-joined with it; what only one block has drops out. Runs lie bucketed by mark, so that history isn't
   shuffled again;
3. blocks of the batch and of the past that share a hash send the words around it (equal ones
   once, with the smallest id), and windows are verified on the words themselves. A hash with HOT different contexts or more is
   hot, and its windows go one by one, dealt by their own hash;
4. a new manifest takes the batch in; beyond MAX_RUNS, the runs are merged into one, in as many buckets as its size asks for, and the old
   ones are removed.

Words are runs of bytes other than space and 0x09-0x0D, compared unchanged.

Cases: a null or empty text has no words; texts below WINDOW words stay whole; a very long text is compared whole, in a block of its own
size; rows that repeat an id (or have none, and then come last) are one document to the others and not removed for each other, so that ties
don't arise; an empty batch gives an empty result; further columns are not read. Ids of a later batch may be smaller; decisions about
earlier batches then stand.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import BASE, U64, can_checkpoint, drop_folder, mix, parallelism, powers, shared_folder, word_hashes, words
from .suffix import _table

WINDOW, GRAM = 50, 8
#: Different contexts of one hash, summed over the blocks, that a task may meet.
HOT = 4000
#: Runs that may lie side by side before they are compacted, and rows of a bucket of a run.
MAX_RUNS, BUCKET_ROWS = 4, 4_000_000

TEXTS = "blk int, pack binary, anchors binary"
CONTEXTS = "key long, blk int, entry long, doc long, before int, windows int, text binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_CONTEXTS = {"key": pa.int64(), "blk": pa.int32(), "entry": pa.int64(), "doc": pa.int64(), "before": pa.int32(), "windows": pa.int32(), "text": pa.binary()}
_RESULT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
_INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def save_bucketed(rows: DataFrame, path: str, key: str, count: int) -> None:
    """Parquet files at `path`, dealt and sorted by `key`. The name in the catalog lasts for the writing only."""
    name = f"veracity_{uuid.uuid4().hex}"
    rows.repartition(count, key).write.bucketBy(count, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")


def load_bucketed(spark: SparkSession, path: str, schema: str, key: str, count: int) -> DataFrame:
    """What save_bucketed() wrote; Spark knows how it is dealt."""
    name = f"veracity_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet OPTIONS (path '{path}') CLUSTERED BY ({key}) SORTED BY ({key}) INTO {count} BUCKETS")
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def spaced(text: str) -> str:
    """The words of a text, joined by one space."""
    return b" ".join(text.encode().split()).decode()


class Texts:
    """A block's documents as words joined by one space."""

    def __init__(self, packs: pa.ChunkedArray):
        rows = blocks.unpack(packs)
        self.all_ids = rows["doc_id"].to_numpy()
        self.texts = [t.encode() for t in rows["text"].to_pylist()]
        self.raw = np.frombuffer(b"\n".join(self.texts), np.uint8)
        sizes = np.array([len(t) + 1 for t in self.texts], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        offsets[-1] = len(self.raw) if len(sizes) else 0
        self.start, self.end, doc = words(self.raw, offsets)
        self.counts = np.bincount(doc, minlength=len(self.texts)) if len(self.texts) else np.zeros(0, np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.counts)))


class Sampled(Texts):
    """A block's texts with the hashes of their words and the anchors of their windows."""

    def __init__(self, packs: pa.ChunkedArray):
        super().__init__(packs)
        self.codes = np.concatenate([np.zeros(0, np.uint64), *(word_hashes(self.raw, self.start[a : a + (1 << 18)], self.end[a : a + (1 << 18)]) for a in range(0, len(self.start), 1 << 18))])
        self.anchors = blocks.sampled_in_slices(lambda a, b: self.codes[a:b], self.offsets, GRAM, WINDOW, 1 << 18)
        self.marks = np.unique(self.anchors.mark)

    def variety(self) -> np.ndarray:
        """Distinct contexts of each mark in this block, told apart by prefix polynomial hashes."""
        a, n = self.anchors, len(self.codes)
        with np.errstate(over="ignore"):
            sums = np.concatenate(([U64(0)], np.cumsum(self.codes * powers(n), dtype=np.uint64)))
            undo = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(n, _INVERSE))))
            context = (sums[a.high + WINDOW] - sums[a.low]) * undo[a.low] + (a.place - a.low).astype(np.uint64)
        _, first = np.unique(mix(context) + a.mark, return_index=True)
        return np.maximum(np.bincount(np.searchsorted(self.marks, a.mark[first]), minlength=len(self.marks)), 1)

    def packed(self) -> bytes:
        """marks with their variety, and the anchors."""
        a = self.anchors
        parts = (self.marks, self.variety().astype(np.int32), a.mark, a.low.astype(np.int32), (a.high - a.low).astype(np.uint8), (a.place - a.low).astype(np.uint8), a.doc.astype(np.int32))
        return np.array([len(self.marks), len(a.mark)], np.int64).tobytes() + zstandard.compress(b"".join(x.tobytes() for x in parts), 3)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, blocks.Anchors]:
    """What Sampled.packed() holds."""
    n, m = np.frombuffer(raw[:16], np.int64).tolist()
    body, at, parts = zstandard.decompress(raw[16:]), 0, []
    for kind, count in ((np.uint64, n), (np.int32, n), (np.uint64, m), (np.int32, m), (np.uint8, m), (np.uint8, m), (np.int32, m)):
        parts.append(np.frombuffer(body, kind, count, at))
        at += parts[-1].nbytes
    marks, variety, mark, *rest = parts
    low, more, before, doc = (x.astype(np.int64) for x in rest)
    return marks, variety, blocks.Anchors(low + before, low, low + more, mark, doc)


class Block(Texts):
    """One block of the index, and the contexts it sends."""

    def __init__(self, packs: pa.ChunkedArray, anchors: bytes):
        super().__init__(packs)
        *_, self.anchors = unpacked(anchors)
        self.ids = self.all_ids[self.anchors.doc]

    def choose(self, notes: pa.Table, own: bool) -> None:
        """Keep the anchors found elsewhere or, in a block of the batch (own), in two documents here, and lay out
        their contexts, each distinct one once."""
        again, many = blocks.noted(notes, blocks.SHARED)
        again = again.view(np.uint64)
        chosen = np.isin(self.anchors.mark, again)
        if own:
            chosen |= blocks.in_two_texts(self.anchors.mark, self.ids)
        found, ids = self.anchors.take(chosen), self.ids[chosen]
        single = np.isin(found.mark, again[many > 0])
        count = np.where(single, found.high - found.low + 1, 1)
        of = np.repeat(np.arange(len(count)), count)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        single = single[of]
        self.low, self.doc = found.low[of] + shift, ids[of]
        self.windows = np.where(single, 1, found.high[of] - found.low[of] + 1)
        before = np.where(single, 0, found.place[of] - self.low)
        key = found.mark[of]
        raw = self.raw.tobytes()
        texts = [raw[a:b] for a, b in zip(self.start[self.low].tolist(), self.end[self.low + self.windows + WINDOW - 2].tolist(), strict=True)]
        for i in np.flatnonzero(single).tolist():
            key[i] = xxhash.xxh64_intdigest(texts[i])
        number: dict[tuple, int] = {}
        self.entry = np.array([number.setdefault(x, len(number)) for x in zip(key.tolist(), before.tolist(), self.windows.tolist(), texts, strict=True)], np.int64)
        self.least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.entry, self.doc)
        self.contexts = list(number)

    def rows(self, blk: int) -> pa.Table:
        key, before, n, text = (list(c) for c in zip(*self.contexts, strict=True)) if self.contexts else ([], [], [], [])
        columns = (np.array(key, np.uint64).view(np.int64), np.full(len(key), blk), np.arange(len(key)), self.least, before, n, text)
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(_CONTEXTS.items(), columns, strict=True)})

    def starts(self, notes: pa.Table) -> np.ndarray:
        """First words of the windows that a smaller id has."""
        entry, told = blocks.noted(notes, blocks.MASK)
        mask = np.zeros(len(self.contexts), np.uint64)
        mask[entry] = told.view(np.uint64)
        full = (U64(1) << self.windows.astype(np.uint64)) - U64(1)
        own = np.where(self.doc > self.least[self.entry], full, mask[self.entry])
        return np.concatenate([self.low[(own >> U64(o)) & U64(1) > 0] + o for o in range(WINDOW - GRAM + 1)])


def verify(contexts: pa.Table) -> np.ndarray:
    """For each context, bit o is set if its window o, word for word, also starts in a smaller id
    among the contexts of the same key."""
    key, doc = contexts["key"].to_numpy(), contexts["doc"].to_pylist()
    before, windows, texts = (contexts[c].to_pylist() for c in ("before", "windows", "text"))
    out = np.zeros(len(key), np.uint64)
    order = np.argsort(key, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True]))) if len(key) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        group = order[a:b].tolist()
        least: dict[tuple, int] = {}
        for i in group:
            same = (before[i], windows[i], texts[i])
            least[same] = min(least.get(same, doc[i]), doc[i])
        if len(least) == 1:
            for i in group:
                if doc[i] > least[before[i], windows[i], texts[i]]:
                    out[i] = U64((1 << windows[i]) - 1)
            continue
        owner: dict[tuple, int] = {}
        cut = {}
        for place, n, text in least:
            parts = text.split(b" ")
            cut[place, n, text] = [(place - o, b" ".join(parts[o : o + WINDOW])) for o in range(n)]
            for window in cut[place, n, text]:
                owner[window] = min(owner.get(window, least[place, n, text]), least[place, n, text])
        for i in group:
            out[i] = U64(sum(1 << o for o, window in enumerate(cut[before[i], windows[i], texts[i]]) if owner[window] < doc[i]))
    return out


class FingerprintIndex:
    """The index at `path`: what its newest manifest names, or empty. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        can_checkpoint(spark)
        self.spark, self.path = spark, path or shared_folder(spark)
        self.version, self.blocks = 0, 0
        self.runs: list[dict] = []  # folder, buckets
        self.batches: list[dict] = []  # folder, buckets, first and last block
        if names := self._manifests():
            self.version = max(names)
            known = json.loads(self.spark.read.text(f"{self.path}/manifest-{self.version}").first()[0])
            self.runs, self.batches, self.blocks = known["runs"], known["batches"], known["blocks"]

    def _manifests(self) -> list[int]:
        """Versions whose writing ended."""
        jvm = self.spark.sparkContext._jvm
        found = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-*/_SUCCESS")
        status = found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found) or []
        return [int(s.getPath().getParent().getName().rpartition("-")[2]) for s in status]

    def _commit(self) -> None:
        self.version += 1
        content = json.dumps({"runs": self.runs, "batches": self.batches, "blocks": self.blocks})
        self.spark.createDataFrame([(content,)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.version}")

    def _write(self, rows: DataFrame, kind: str, key: str, buckets: int) -> dict:
        folder = f"{kind}-{uuid.uuid4().hex}"
        save_bucketed(rows, f"{self.path}/{folder}", key, buckets)
        return {"folder": folder, "buckets": buckets}

    def _run(self, run: dict) -> DataFrame:
        return load_bucketed(self.spark, f"{self.path}/{run['folder']}", blocks.MARKS, "mark", run["buckets"])

    def _texts(self, batch: dict) -> DataFrame:
        return load_bucketed(self.spark, f"{self.path}/{batch['folder']}", TEXTS, "blk", batch["buckets"])

    def compact(self) -> None:
        """Merge all runs into one and remove them."""
        rows, old = self._run(self.runs[0]), self.runs
        for run in old[1:]:
            rows = rows.unionByName(self._run(run))
        self.runs = [self._write(rows, "run", "mark", max(parallelism(self.spark), -(-rows.count() // BUCKET_ROWS)))]
        self._commit()
        for run in old:
            drop_folder(self.spark, f"{self.path}/{run['folder']}")

    def add(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_words, n_removed and the digest of the kept words, for docs(doc_id, text); the batch
        then belongs to the past."""
        first, count = self.blocks, blocks.block_count(docs)

        def sample(packed: pa.Table) -> pa.Table:
            """A block as one row: its texts in one pack, and its anchors."""
            return pa.table([packed["blk"].slice(0, 1), pa.array([blocks.merged(packed["pack"])], pa.binary()), pa.array([Sampled(packed["pack"]).packed()], pa.binary())], names=["blk", "pack", "anchors"])

        dealt = blocks.packs_of(docs, count, first, spaced).repartition(parallelism(self.spark), "blk")
        batch = self._write(dealt.groupBy("blk").applyInArrow(sample, TEXTS), "texts", "blk", parallelism(self.spark)) | {"first": first, "last": first + count - 1}
        packs = self._texts(batch)

        def send_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for blk, anchors in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    marks, variety, _ = unpacked(anchors)
                    yield from blocks.mark_rows(blk, marks, variety).to_batches()

        run = self._write(packs.select("blk", "anchors").mapInArrow(send_marks, blocks.MARKS), "run", "mark", parallelism(self.spark))
        new = self._run(run)
        marks, fresh = new, new.select("mark").distinct().hint("merge")
        for older in self.runs:
            marks = marks.unionByName(self._run(older).join(fresh, "mark", "left_semi"))
        # Only what the batch has needs an answer.
        seen = blocks.met(marks, HOT, f"at >= {first}").checkpoint()

        def send_contexts(packed: pa.Table, notes: pa.Table) -> pa.Table:
            blk = packed["blk"][0].as_py() if packed.num_rows else 0
            if not packed.num_rows or blk < first and not notes.num_rows:
                return _table(_CONTEXTS, [])
            block = Block(packed["pack"], packed["anchors"][0].as_py())
            block.choose(notes, blk >= first)
            return block.rows(blk)

        def verify_contexts(sent: pa.Table) -> pa.Table:
            masks, blk = verify(sent), sent["blk"].to_numpy()
            some = (masks > 0) & (blk >= first)
            return blocks.note_rows(blk[some], blocks.MASK, sent["entry"].to_numpy()[some], masks[some].view(np.int64))

        def cogrouped(side: DataFrame, notes: DataFrame, step, schema: str) -> DataFrame:
            return side.groupBy("blk").cogroup(notes.groupBy("blk")).applyInArrow(step, schema)

        own = seen.where(F.col("blk") >= first)
        contexts = cogrouped(packs, own, send_contexts, CONTEXTS)
        for past in self.batches:
            contexts = contexts.unionByName(cogrouped(self._texts(past), seen.where(F.col("blk").between(past["first"], past["last"])), send_contexts, CONTEXTS))
        masks = blocks.bucketed(contexts, seen, WINDOW - GRAM + 1).groupBy("bucket").applyInArrow(verify_contexts, blocks.NOTES).checkpoint()

        def remove(packed: pa.Table, notes: pa.Table) -> pa.Table:
            if not packed.num_rows:
                return _table(_RESULT, [])
            block = Block(packed["pack"], packed["anchors"][0].as_py())
            block.choose(notes, True)
            gone = blocks.covered(block.starts(notes), WINDOW, len(block.start))
            rows = []
            for i, doc in enumerate(block.all_ids.tolist()):
                out = gone[block.offsets[i] : block.offsets[i + 1]]
                text = block.texts[i]
                if out.any():
                    text = b" ".join(w for w, o in zip(text.split(b" "), out.tolist(), strict=True) if not o)
                rows.append((doc, len(out), int(out.sum()), hashlib.sha256(text).hexdigest()))
            return _table(_RESULT, rows)

        result = blocks.with_ids(cogrouped(packs, own.unionByName(masks), remove, RESULT))
        self.batches.append(batch)
        self.runs.append(run)
        self.blocks += count
        self._commit()
        if len(self.runs) > MAX_RUNS:
            self.compact()
        return result


def remove_repeats(docs: DataFrame, batches: int = MAX_RUNS + 2) -> DataFrame:
    """Add docs(doc_id, text) to a fresh index in batches of ascending ids; by default so many that the
    index is compacted and the last batch is merged with the compacted run."""
    index, place = FingerprintIndex(docs.sparkSession), blocks.id_of()
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    cuts = [low + (high + 1 - low) * i // batches for i in range(batches)]
    out = None
    for i, cut in enumerate(cuts):
        rows = docs.where((place >= cut) & (place < cuts[i + 1])) if i + 1 < batches else docs.where(place >= cut)
        part = index.add(rows)
        out = part if out is None else out.unionByName(part)
    return out
