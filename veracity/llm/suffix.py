"""Operator 2: removal of repeated byte strings by hash-compared suffix sorting.

A byte goes if a WINDOW-byte string that covers it also starts in a document with a smaller id.
Windows are judged on the input. Steps, each a Spark stage over blocks of documents:

1. exact copies: only the smallest id of equal texts goes on (a copy of WINDOW bytes or more is
   removed whole);
2. anchors: each block sends the marks of its sampled windows, a row each; a mark that one block's documents
   alone have, and one document only, drops out. A mark is that of GRAM bytes, more than half a window: shorter runs of bytes
   recur by chance, the more the larger the table is, and each such mark would ask for contexts that hold no repeat;
3. contexts: blocks send the bytes around the remaining anchors, equal ones once with the smallest
   id. An anchor of HOT distinct contexts or more is hot: its windows go one by one, dealt by
   their own hash, so that no task meets all of its contexts;
4. suffix sort: where an anchor has several contexts, the suffixes at their window starts are merge-sorted.
   Two suffixes that begin alike are compared by binary search over prefix polynomial hashes for
   their common extension and the byte after it; neighbours that come out equal are verified byte by byte.
   Equal suffixes are one class with a smallest id;
5. removal: each block learns which of its windows start in a smaller id.

A task meets one row of a context from each block at most, and whole blocks of BLOCK_BYTES of text. What a block and a bucket of
marks or contexts tell each other is one packed row: there are as many as there are blocks times buckets, and never more than marks or contexts.

Cases: a null or empty text has no bytes and nothing to remove; texts below WINDOW bytes stay whole; a very long text
is compared whole, in a block of its own size; rows that repeat an id (or have none, and then come last) are one document to the
others and not removed for each other, so that ties don't arise; repeated rows are rows of the result each; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import BASE, BYTE_CODE, U64, can_checkpoint, flat, mix, powers

WINDOW, GRAM = 50, 32
#: Bytes sampled together: as many as a processor's cache holds the hashes of.
SLICE = 1 << 15
#: Contexts of one anchor, summed over the blocks, that a task may meet.
HOT = 4000
#: Contexts of a bucket, about.
BUCKET_ROWS = 40_000
#: Bytes of a mark that a bucket compares, and the bit of its variety that says that two documents of a block have it.
_MARK_BYTES, _TWO = 5, 1 << 15
#: Bytes of a context: the most windows that can share an anchor, side by side.
WIDTH = WINDOW + WINDOW - GRAM
_ROW = WIDTH + 2  # bytes, place of the anchor, number of windows
#: By number of windows: the bytes of a context that they hold.
_HELD = np.where(np.arange(WIDTH) < np.arange(WINDOW - GRAM + 2)[:, None] + WINDOW - 1, 255, 0).astype(np.uint8)
_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_FAR = np.iinfo(np.int64).max


class PrefixHashes:
    """Prefix polynomial hashes of the rows of a byte matrix."""

    def __init__(self, rows: np.ndarray):
        self.rows, width = rows, rows.shape[1]
        with np.errstate(over="ignore"):
            self.sums = np.zeros((len(rows), width + 1), np.uint64)
            np.cumsum(BYTE_CODE[rows] * powers(width), axis=1, out=self.sums[:, 1:])
            self.undo = np.multiply.accumulate(np.concatenate(([U64(1)], np.full(width, _INVERSE))))

    def part(self, row: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[row, at + length] - self.sums[row, at]) * self.undo[at]

    def common(self, row_a, at_a, row_b, at_b, most: int) -> np.ndarray:
        """Length of the common extension of suffix pairs, `most` at most, by binary search."""
        low, high = np.zeros(len(row_a), np.int64), np.full(len(row_a), most)
        for _ in range(most.bit_length()):
            mid = (low + high + 1) // 2
            same = self.part(row_a, at_a, mid) == self.part(row_b, at_b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, np.minimum(mid - 1, high))
            high = np.maximum(low, high)
        return low


def suffix_classes(rows: np.ndarray, row: np.ndarray, at: np.ndarray, cell: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """A class number for each suffix (row, at): equal within a cell iff the next `length` bytes are.
    Bottom-up mergesort of all cells side by side, suffixes compared through prefix hashes."""
    hashes = PrefixHashes(rows)
    order = np.argsort(cell, kind="stable")
    sizes = np.unique(cell, return_counts=True)[1]
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    stop = start + np.repeat(sizes, sizes)
    index = np.arange(len(order)) - start

    # What most comparisons need, once for each suffix: its first bytes as a number, the hash of all.
    head = np.ascontiguousarray(rows[row[:, None], at[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)
    full = hashes.part(row, at, length)

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = head[a], head[b]
        out = (x > y).astype(np.int64) - (x < y)
        deep = np.flatnonzero((out == 0) & (full[a] != full[b]))
        a, b = a[deep], b[deep]
        shared = hashes.common(row[a], at[a], row[b], at[b], length - 1)
        out[deep] = rows[row[a], at[a] + shared].astype(np.int64) - rows[row[b], at[b] + shared]
        return out

    width, most = 1, int(sizes.max(initial=0))
    while width < most:
        live = np.flatnonzero(stop - start > width)
        run = index[live] // width
        twin = start[live] + (run ^ 1) * width
        low = np.minimum(twin, stop[live])
        first, high = low.copy(), np.minimum(twin + width, stop[live])
        right = run % 2 == 1
        while (open_ := low < high).any():
            mid = (low + high) // 2
            sub = np.flatnonzero(open_)
            sign = compare(order[mid[sub]], order[live[sub]])
            below = np.where(right[sub], sign <= 0, sign < 0)
            low[sub] = np.where(below, mid[sub] + 1, low[sub])
            high[sub] = np.where(below, high[sub], mid[sub])
        place = start[live] + (run // 2) * 2 * width + index[live] % width + (low - first)
        order[place] = order[live].copy()
        width *= 2
    same = cell[order[1:]] == cell[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    equal = np.zeros(len(same), bool)
    equal[same] = full[a] == full[b]
    a, b, columns = order[:-1][equal], order[1:][equal], np.arange(length)
    if (rows[row[a][:, None], at[a][:, None] + columns] != rows[row[b][:, None], at[b][:, None] + columns]).any():
        # Two different strings share a hash: settle the classes on the bytes themselves.
        text = np.ascontiguousarray(np.concatenate([np.ascontiguousarray(cell.astype(np.int64)).view(np.uint8).reshape(-1, 8), rows[row[:, None], at[:, None] + columns]], 1))
        return np.unique(text.view(f"V{8 + length}").ravel(), return_inverse=True)[1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.concatenate(([True], ~equal))[: len(order)])
    return out


def unique_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct row, and the number of its distinct row for every row. Rows are sorted by
    a hash, and those of one hash verified to be equal."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(np.uint64)
    hashes = row_hashes(words)
    order = np.argsort(hashes)
    new = np.concatenate(([True], hashes[order[1:]] != hashes[order[:-1]]))
    again = np.flatnonzero(~new)
    if (words[order[again]] != words[order[again - 1]]).any():
        # Two different rows share a hash: sort the bytes themselves.
        _, first, back = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
        return first, back.ravel()
    back = np.empty(len(rows), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def row_hashes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for column in words.T:
            out = (out + column) * BASE
            out ^= out >> U64(29)
    return out


def smaller(key: np.ndarray, doc: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each context (group key, id, row): bit o is set if its window o also starts in a
    smaller id among the contexts of its key."""
    if not len(rows):
        return np.zeros(0, np.uint64)
    first, back = unique_rows(np.concatenate([key.view(np.uint8).reshape(-1, 8), rows], 1))
    least = np.full(len(first), _FAR)
    np.minimum.at(least, back, doc)
    _, group, size = np.unique(key[first], return_inverse=True, return_counts=True)
    count = rows[first, WIDTH + 1].astype(np.int64)
    owner = np.where(np.arange(WIDTH)[None, : WINDOW - GRAM + 1] < count[:, None], least[:, None], _FAR)
    mixed = np.flatnonzero(size[group] > 1)
    if len(mixed):
        row = np.repeat(np.arange(len(mixed)), count[mixed])
        at = np.arange(len(row)) - np.repeat(np.cumsum(count[mixed]) - count[mixed], count[mixed])
        cell = group[mixed][row] * 256 + (rows[first[mixed], WIDTH].astype(np.int64)[row] - at)
        kind = suffix_classes(rows[first[mixed], :WIDTH], row, at, cell)
        best = np.full(int(kind.max()) + 1, _FAR)
        np.minimum.at(best, kind, least[mixed][row])
        owner[mixed[row], at] = best[kind]
    hit = owner[back] < doc[:, None]
    return (hit.astype(np.uint64) << np.arange(hit.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)


def in_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys fall in, and the edges of their parts."""
    bucket = (keys >> U64(32)) * U64(buckets) >> U64(32)
    edges = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
    return bucket[edges[:-1]].astype(np.int64), edges


def packed_notes(kind: int, rows: list[tuple]) -> pa.Table:
    """Notes of (block, two numbers, bytes)."""
    blk, a, b, packed = zip(*rows, strict=True) if rows else ((),) * 4
    return blocks.note_rows(np.array(blk, np.int32), kind, np.array(a, np.int64), np.array(b, np.int64), packed)


def find_shared(sent: pa.Table) -> pa.Table:
    """For each block's marks of a bucket: bits of those that another block or two of its documents have, and of the hot ones; and
    how many contexts that asks for."""
    blk, packs = sent["blk"].to_pylist(), sent["marks"].to_pylist()
    mark = np.zeros((sum(map(len, packs)) // _MARK_BYTES, 8), np.uint8)
    mark[:, :_MARK_BYTES] = np.frombuffer(b"".join(packs), np.uint8).reshape(-1, _MARK_BYTES)
    mark, variety = mark.view(np.uint64).ravel(), np.frombuffer(b"".join(sent["variety"].to_pylist()), np.uint16)
    order = np.argsort(mark)
    first = np.flatnonzero(np.concatenate(([True], mark[order[1:]] != mark[order[:-1]])))
    times = np.diff(first, append=len(order))
    many = np.add.reduceat((variety & (_TWO - 1))[order], first, dtype=np.int64) >= HOT
    shared, hot = np.empty(len(order), bool), np.empty(len(order), bool)
    hot[order] = np.repeat(many, times)
    shared[order] = np.repeat(many | (times > 1), times)
    shared |= variety >= _TWO
    rows, i = [], 0
    for b, name, pack in zip(blk, sent["bucket"].to_pylist(), packs, strict=True):
        own = slice(i, i := i + len(pack) // _MARK_BYTES)
        if asked := int(shared[own].sum() + hot[own].sum() * (WINDOW - GRAM)):
            rows.append((b, name, asked, np.packbits(np.stack((shared[own], hot[own])), axis=1).tobytes()))
    return packed_notes(blocks.SHARED, rows)


def sort_suffixes(sent: pa.Table) -> pa.Table:
    """For each block's contexts of a bucket: those with windows that a smaller id has, and their masks."""
    key, doc, rows = (np.frombuffer(b"".join(sent[name].to_pylist()), kind) for name, kind in (("key", np.uint64), ("doc", np.int64), ("context", np.uint8)))
    masks = smaller(key, doc, rows.reshape(-1, _ROW))
    out, i = [], 0
    for blk, packed in zip(sent["blk"].to_pylist(), sent["entry"].to_pylist(), strict=True):
        entry = np.frombuffer(packed, np.uint32)
        own = masks[i : (i := i + len(entry))]
        if (some := own > 0).any():
            out.append((blk, 0, 0, np.concatenate((entry[some], own[some].astype(np.uint32))).tobytes()))
    return packed_notes(blocks.MASK, out)


class Block:
    """One block's documents (exact copies left out), anchors, and the contexts it sends."""

    def __init__(self, packs: pa.ChunkedArray, notes: pa.Table):
        rows = blocks.unpack(packs)
        self.all_ids = rows["doc_id"].to_numpy()
        self.raw, self.offsets = flat(rows["text"])
        told = notes.filter(pa.array(notes["kind"].to_numpy() == blocks.COPY))
        copies = set(zip(told["a"].to_pylist(), told["digest"].to_pylist(), strict=True))
        maybe = {i for i, _ in copies}
        self.copied = np.array([d in maybe and (d, hashlib.sha256(self.raw[a:b]).digest()) in copies for d, a, b in zip(self.all_ids.tolist(), self.offsets[:-1], self.offsets[1:], strict=True)], bool)
        lengths = np.where(self.copied, 0, np.diff(self.offsets))
        keep = np.repeat(~self.copied, np.diff(self.offsets))
        raw = np.concatenate((self.raw[keep], np.zeros(WIDTH, np.uint8)))
        self.own, self.own_offsets = raw[:-WIDTH], np.concatenate(([0], np.cumsum(lengths)))
        self.wide = np.lib.stride_tricks.sliding_window_view(raw, WIDTH)
        self.anchors = blocks.sampled_in_slices(lambda a, b: BYTE_CODE[raw[a:b]], self.own_offsets, GRAM, WINDOW, SLICE)
        self.ids = self.all_ids[self.anchors.doc]
        self.anchors.mark = mix(self.anchors.mark)  # anchors have the least hashes: spread them again
        # The distinct marks, the anchors in their order, and the number of each anchor's mark.
        self.order = np.argsort(self.anchors.mark)
        mark = self.anchors.mark[self.order]
        new = np.concatenate(([True], mark[1:] != mark[:-1]))[: len(mark)]
        self.first = np.flatnonzero(new)
        self.marks, self.where = mark[new], np.empty(len(mark), np.int64)
        self.where[self.order] = np.cumsum(new) - 1

    def contexts(self, low: np.ndarray, windows: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The rows of contexts: bytes of the windows from `low` on, place of the anchor, number of windows."""
        rows = np.empty((len(low), _ROW), np.uint8)
        for a in range(0, len(low), 50_000):
            rows[a : a + 50_000, :WIDTH] = self.wide[low[a : a + 50_000]] & _HELD[windows[a : a + 50_000]]
        rows[:, WIDTH], rows[:, WIDTH + 1] = before, windows
        return rows

    def variety(self) -> np.ndarray:
        """Distinct contexts of each mark in this block."""
        again = (np.diff(self.first, append=len(self.order)) > 1)[self.where]
        some, where = self.anchors.take(again), self.where[again]
        rows = self.contexts(some.low, some.high - some.low + 1, some.place - some.low)
        first, _ = unique_rows(np.concatenate([some.mark.view(np.uint8).reshape(-1, 8), rows], 1))
        return np.maximum(np.bincount(where[first], minlength=len(self.marks)), 1)

    def in_two_texts(self) -> np.ndarray:
        """Whether each mark occurs in texts of two ids or more of the block."""
        ids = self.ids[self.order]
        return np.minimum.reduceat(ids, self.first) < np.maximum.reduceat(ids, self.first) if len(ids) else np.zeros(0, bool)

    def mark_packs(self, buckets: int) -> pa.Table:
        """A row for each bucket of marks that the block has some of: the marks, and how many contexts each has."""
        variety = np.minimum(self.variety(), _TWO - 1) | np.where(self.in_two_texts(), _TWO, 0)
        names, edges = in_buckets(self.marks, buckets)
        low, variety = self.marks.view(np.uint8).reshape(-1, 8)[:, :_MARK_BYTES], variety.astype(np.uint16)
        return _table(_MARKS, [(b, low[i:j].tobytes(), variety[i:j].tobytes()) for b, i, j in zip(names.tolist(), edges[:-1], edges[1:], strict=True)])

    def choose(self, notes: pa.Table, buckets: int) -> None:
        """Keep the anchors found elsewhere or in two documents here, and lay out their contexts, each
        distinct one once."""
        again, hot = np.zeros(len(self.marks), bool), np.zeros(len(self.marks), bool)
        names, edges = in_buckets(self.marks, buckets)
        told = notes.filter(pa.array(notes["kind"].to_numpy() == blocks.SHARED))
        for at, packed in zip(np.searchsorted(names, told["a"].to_numpy()), told["digest"].to_pylist(), strict=True):
            own, bits = slice(edges[at], edges[at + 1]), np.frombuffer(packed, np.uint8)
            again[own], hot[own] = np.unpackbits(bits.reshape(2, -1), axis=1, count=edges[at + 1] - edges[at])
        chosen = again[self.where]
        found, ids, hot = self.anchors.take(chosen), self.ids[chosen], hot[self.where[chosen]]
        # A hot anchor's windows become contexts of one window each.
        count = np.where(hot, found.high - found.low + 1, 1)
        of = np.repeat(np.arange(len(count)), count)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        single = hot[of]
        self.low = found.low[of] + shift
        windows = np.where(single, 1, found.high[of] - found.low[of] + 1)
        rows = self.contexts(self.low, windows, np.where(single, 0, found.place[of] - self.low))
        key = found.mark[of]
        if single.any():
            with np.errstate(over="ignore"):
                key[single] = mix((BYTE_CODE[rows[single, :WINDOW]] * powers(WINDOW)).sum(1, dtype=np.uint64))
        first, self.entry = unique_rows(np.concatenate([key.view(np.uint8).reshape(-1, 8), rows], 1))
        self.doc, self.windows = ids[of], windows
        self.least = np.full(len(first), _FAR)
        np.minimum.at(self.least, self.entry, self.doc)
        self.key, self.rows = key[first], rows[first]

    def context_packs(self, buckets: int) -> pa.Table:
        """A row for each bucket of contexts that the block has some of."""
        order = np.argsort(self.key)
        key = self.key[order]
        names, edges = in_buckets(key, buckets)
        rows = [(b, key[i:j].tobytes(), self.least[order[i:j]].tobytes(), order[i:j].astype(np.uint32).tobytes(), self.rows[order[i:j]].tobytes()) for b, i, j in zip(names.tolist(), edges[:-1], edges[1:], strict=True)]
        return _table(_CONTEXTS, rows)

    def starts(self, notes: pa.Table) -> np.ndarray:
        """First bytes of the windows that a smaller id has."""
        mask = np.zeros(len(self.key), np.uint64)
        for packed in notes.filter(pa.array(notes["kind"].to_numpy() == blocks.MASK))["digest"].to_pylist():
            entry, told = np.frombuffer(packed, np.uint32).reshape(2, -1)
            mask[entry] = told
        # In the block's other documents with the same context every window is such.
        full = (U64(1) << self.windows.astype(np.uint64)) - U64(1)
        own = np.where(self.doc > self.least[self.entry], full, mask[self.entry])
        out = [self.low[(own >> U64(o)) & U64(1) > 0] + o for o in range(WINDOW - GRAM + 1)]
        return np.concatenate(out)


MARKS = "bucket int, marks binary, variety binary, blk int"
CONTEXTS = "bucket int, key binary, doc binary, entry binary, context binary, blk int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_MARKS = {"bucket": pa.int32(), "marks": pa.binary(), "variety": pa.binary()}
_CONTEXTS = {"bucket": pa.int32(), "key": pa.binary(), "doc": pa.binary(), "entry": pa.binary(), "context": pa.binary()}
_RESULT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}


def _table(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), columns, strict=True)})


def exact_copies(docs: DataFrame, count: int) -> DataFrame:
    """Notes of the documents whose whole text an id below theirs has. The least ids are checkpointed, so
    that Spark can split a text that many rows share in the join."""
    rows = docs.where(F.octet_length("text") >= WINDOW).select(blocks.id_of().alias("doc_id"), F.sha2("text", 256).alias("h"), blocks.block_of(count).alias("blk"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("h", "least").checkpoint()
    found = rows.join(first, "h").where("doc_id > least")
    return found.select("blk", F.lit(blocks.COPY).alias("kind"), F.col("doc_id").alias("a"), F.lit(0).cast("long").alias("b"), F.unhex("h").alias("digest"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left, for docs(doc_id, text)."""
    spark = docs.sparkSession
    can_checkpoint(spark)
    count = blocks.block_count(docs)
    packs = blocks.deal(docs, count)
    copies = exact_copies(docs, count).checkpoint()

    def cogrouped(notes: DataFrame, step, schema: str) -> DataFrame:
        return packs.groupBy("blk").cogroup(notes.groupBy("blk")).applyInArrow(step, schema)

    buckets = -(-count // 2)

    def to_buckets(packed: pa.Table, kinds: dict[str, pa.DataType], rows) -> pa.Table:
        out = rows() if packed.num_rows else _table(kinds, [])
        return out.append_column("blk", pa.array([packed["blk"][0].as_py()] * out.num_rows if packed.num_rows else [], pa.int32()))

    def send_marks(packed: pa.Table, notes: pa.Table) -> pa.Table:
        return to_buckets(packed, _MARKS, lambda: Block(packed["pack"], notes).mark_packs(buckets))

    shared = cogrouped(copies, send_marks, MARKS).groupBy("bucket").applyInArrow(find_shared, blocks.NOTES)
    notes = copies.unionByName(blocks.settled(shared, "blk"))
    asked = notes.where(F.col("kind") == blocks.SHARED).agg(F.sum("b")).first()[0] or 0
    context_buckets = max(blocks.parallelism(spark), -(-asked // BUCKET_ROWS))

    def send_contexts(packed: pa.Table, notes: pa.Table) -> pa.Table:
        def rows() -> pa.Table:
            block = Block(packed["pack"], notes)
            block.choose(notes, buckets)
            return block.context_packs(context_buckets)

        return to_buckets(packed, _CONTEXTS, rows)

    masks = cogrouped(notes, send_contexts, CONTEXTS).groupBy("bucket").applyInArrow(sort_suffixes, blocks.NOTES)

    def remove(packed: pa.Table, notes: pa.Table) -> pa.Table:
        if not packed.num_rows:
            return _table(_RESULT, [])
        block = Block(packed["pack"], notes)
        block.choose(notes, buckets)
        gone = blocks.covered(block.starts(notes), WINDOW, len(block.own))
        rows, own = [], block.own_offsets
        for i, doc in enumerate(block.all_ids.tolist()):
            body = block.raw[block.offsets[i] : block.offsets[i + 1]]
            if block.copied[i]:
                rows.append((doc, len(body), len(body), 1, hashlib.sha256(b"").hexdigest()))
                continue
            out = gone[own[i] : own[i + 1]]
            runs = int(np.count_nonzero(out[1:] & ~out[:-1]) + out[:1].sum())
            rows.append((doc, len(body), int(out.sum()), runs, hashlib.sha256(body[~out].tobytes()).hexdigest()))
        return _table(_RESULT, rows)

    return blocks.with_ids(cogrouped(notes.unionByName(masks), remove, RESULT))
