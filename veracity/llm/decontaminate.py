"""Operator 5: benchmark decontamination by q-gram lemma filtering.

Texts and items are compared in lower case with each run of white space as one space. A region
that lies within e edits of an item of m characters shares at least m - Q + 1 - Q * e of the item's
q-grams with it, on diagonals at most e apart. Shared q-grams are counted in diagonal bands of twice
that width that overlap by half, bands that reach the bound are kept, and a banded alignment
of the item inside the region decides.

Q characters of 8 bits are one 64-bit number, so the q-grams of a text are its bytes read at every place; characters beyond
Latin-1 are folded to 8 bits, which only adds shared q-grams. A place of the text counts once a band, however often its q-gram
stands in the item there: places of an item that lie within a band of each other are one stretch, so that repetitive texts and items have
no more hits than others. Hits are counted LIMIT at a time.

The items are taken in blocks of at most BLOCK_CHARS characters, each broadcast in turn; every
text is read against every block.

Cases: a null or empty text is clean; null, empty or blank items match nothing; an item shorter
than Q characters must occur exactly; a very long text or item is compared whole; equal items are all reported; a text that several bands or items
fit has each item once; repeated rows are judged one by one; an id may be missing (items found without one are reported as one null, last); an empty benchmark or table gives no match; further columns pass
through where rows are filtered, one named like the result is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, slices, small_batches

#: q-gram length (of 8-bit characters in a 64-bit number); edits allowed, as a share of an item's characters.
Q, EDITS = 8, 0.1
#: Characters of benchmark items in one broadcast block (about 30 bytes each with the index).
BLOCK_CHARS = 1 << 20
#: Hits that are counted at once; cells of alignments side by side; characters and diagonals from which an item is aligned alone.
LIMIT, CELLS, LONG = 1 << 20, 1 << 21, 1 << 16
_SPREAD = U64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(m: int) -> int:
    """Edits allowed for an item of m characters: a tenth, but never so many that the q-gram
    bound falls below one shared q-gram."""
    return max(0, min(int(EDITS * m), (m - Q) // Q))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def narrow(text: str) -> np.ndarray:
    """The characters of a text in 8 bits: equal characters are equal."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        wide = codes(text)
        return (wide ^ (wide >> np.uint32(8)) ^ (wide >> np.uint32(16))).astype(np.uint8)


def q_grams(chars: np.ndarray) -> np.ndarray:
    """The number at every place with Q characters from it on."""
    n = len(chars) - Q + 1
    return np.ndarray((n,), "<u8", chars, strides=(1,)) if n > 0 else np.zeros(0, np.uint64)


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    distinct, of = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(of, counts, len(distinct)).astype(np.int64)


def spread(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first .. first + many - 1: the range each element is of, and the elements."""
    of = np.repeat(np.arange(len(many)), many)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)


class Block:
    """Items of one block with their sorted q-grams: for each q-gram the stretches of item places it has."""

    def __init__(self, items: list[tuple[int, str]]):
        items = [(i, t) for i, t in items if t]
        self.short = [(i, t) for i, t in items if len(t) < Q]
        self.long = [(i, t) for i, t in items if len(t) >= Q]
        self.size = np.array([len(t) for _, t in self.long], np.int64)
        self.edits = np.array([budget(n) for n in self.size.tolist()], np.int64)
        self.bound = self.size - Q + 1 - Q * self.edits
        found = [q_grams(narrow(t)) for _, t in self.long]
        gram = np.concatenate([np.zeros(0, np.uint64), *found])
        item = np.repeat(np.arange(len(found)), [len(x) for x in found])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(x)) for x in found)])
        order = np.lexsort((place, item, gram))
        gram, item, place = gram[order], item[order], place[order]
        # A stretch goes on while the next place of the same q-gram and item is at most a band's step away.
        near = (gram[1:] == gram[:-1]) & (item[1:] == item[:-1]) & (place[1:] - place[:-1] <= self.edits[item[1:]] + 1)
        head = np.flatnonzero(np.concatenate(([True], ~near)[: len(gram)])) if len(gram) else np.zeros(0, np.int64)
        tail = np.concatenate((head[1:], [len(gram)]))[: len(head)] - 1
        self.item, self.low, self.high = item[head], place[head], place[tail]
        self.gram, self.first, self.count = np.unique(gram[head], return_index=True, return_counts=True)
        bits = max(16, min(24, int(len(self.gram) * 16).bit_length()))
        self.shift = U64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.slot(self.gram)] = True

    def slot(self, gram: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((gram * _SPREAD) >> self.shift).view(np.int64)

    def hits(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the texts whose q-gram some item has, and which of the q-grams it is."""
        gram, at, which = q_grams(chars), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(gram) if len(self.gram) else 0, 1 << 16):  # pieces that stay in the processor's cache
            part = gram[a : a + (1 << 16)]
            some = np.flatnonzero(self.maybe[self.slot(part)])
            where = np.minimum(np.searchsorted(self.gram, part[some]), len(self.gram) - 1)
            true = self.gram[where] == part[some]
            at.append(some[true] + a), which.append(where[true])
        return np.concatenate(at), np.concatenate(which)

    def regions(self, chars: np.ndarray, start: np.ndarray) -> np.ndarray:
        """(text, item, first diagonal) of the bands that reach the bound in texts side by side; start: where each text
        begins."""
        at, which = self.hits(chars)
        text, n = np.searchsorted(start, at, "right") - 1, max(len(self.long), 1)
        none = np.zeros(0, np.int64)

        def stretches():
            """Hits (place, text, stretch), about LIMIT at a time."""
            done, total = 0, np.cumsum(self.count[which])
            while done < len(at):
                stop = max(int(np.searchsorted(total, (total[done - 1] if done else 0) + LIMIT, "right")), done + 1)
                of, row = spread(self.first[which[done:stop]], self.count[which[done:stop]])
                yield at[done:stop][of], text[done:stop][of], row
                done = stop

        # A pair with fewer shared q-grams than the bound in all has no band that reaches it.
        pairs, counts = none, none
        for place, t, row in stretches():
            pair = t * n + self.item[row]
            pair = pair[np.concatenate(([True], (pair[1:] != pair[:-1]) | (place[1:] != place[:-1])))]  # a place counts once
            pairs, counts = tally(np.concatenate([pairs, pair]), np.concatenate([counts, np.ones(len(pair), np.int64)]))
        pairs = pairs[counts >= self.bound[pairs % n]]
        if not len(pairs):
            return np.zeros((0, 3), np.int64)
        key, count, wide = none, none, int(2 * (len(chars) + self.size.max()) + 4)
        for place, t, row in stretches():
            pair = t * n + self.item[row]
            enough = pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair
            place, t, row, pair = place[enough], t[enough], row[enough], pair[enough]
            item = self.item[row]
            step = self.edits[item] + 1
            # A band b covers diagonals [b * step, (b + 2) * step): each diagonal lies in two.
            diagonal = place - start[t] + self.size[item]  # of item place 0; not negative for the others
            least, most = (diagonal - self.high[row]) // step, (diagonal - self.low[row]) // step + 1  # plus one, from 0
            # A later stretch of the same place and item has lower bands; what both have counts once.
            again = np.flatnonzero((place[1:] == place[:-1]) & (pair[1:] == pair[:-1])) + 1
            most[again] = np.minimum(most[again], least[again - 1] - 1)
            of, band = spread(least, np.maximum(most - least + 1, 0))
            key, count = tally(np.concatenate([key, pair[of] * wide + band]), np.concatenate([count, np.ones(len(of), np.int64)]))
        found, band = key // wide, key % wide - 1
        keep = np.flatnonzero(count >= self.bound[found % n])
        keep = keep[np.argsort(-count[keep], kind="stable")]  # the fullest band first: the others are then often spared
        text, item = found[keep] // n, found[keep] % n
        return np.stack([text, item, band[keep] * (self.edits[item] + 1) - self.size[item]], 1)


def extension(item: np.ndarray, text: np.ndarray, i: int, j: int) -> int:
    """How many characters from item place i and text place j on are equal."""
    n, done, size = min(len(item) - i, len(text) - j), 0, 64
    while done < n:
        size = min(size, n - done)
        other = np.flatnonzero(item[i + done : i + done + size] != text[j + done : j + done + size])
        if len(other):
            return done + int(other[0])
        done, size = done + size, size * 4
    return n


def long_banded(item: np.ndarray, text: np.ndarray, low: int, width: int, most: int) -> bool:
    """banded() for one long item, without a row of cells a character: for 0, 1, 2, ... edits the furthest item place that
    is reached on each diagonal of the band, following stretches of equal characters."""
    m, n = len(item), len(text)
    if n < m - most:
        return False
    diagonals = np.arange(low, low + width)
    never = -2 - m

    def follow(reach: np.ndarray) -> np.ndarray:
        live = np.flatnonzero((reach >= 0) & (reach <= m) & (reach + diagonals >= 0) & (reach + diagonals <= n))
        out = np.full(width, never)
        out[live] = reach[live]
        for _ in range(8):  # most stretches are short; those that aren't are followed one by one, from the middle of the band
            live = live[(out[live] < m) & (out[live] + diagonals[live] < n)]
            live = live[item[out[live]] == text[out[live] + diagonals[live]]]
            out[live] += 1
        for k in live[np.argsort(np.abs(live - width // 2), kind="stable")].tolist():
            out[k] += extension(item, text, int(out[k]), int(out[k] + diagonals[k]))
            if out[k] >= m:
                break
        return out

    # The stretch may begin anywhere in the text, so each diagonal starts at the item's first place.
    reach = follow(np.where(diagonals >= 0, 0, never))
    for edits in range(most + 1):
        if reach.max(initial=-1) >= m:
            return True
        if edits == most:
            break
        new = reach + 1  # another character
        new[1:] = np.maximum(new[1:], reach[:-1])  # a text character is put in
        new[:-1] = np.maximum(new[:-1], reach[1:] + 1)  # an item character is dropped
        # Before the text's first character only item characters can be dropped.
        start = np.where((diagonals < 0) & (-diagonals <= edits + 1), -diagonals, never)
        reach = np.maximum(reach, follow(np.minimum(np.maximum(new, start), m)))
    return False


def banded(items: list[np.ndarray], texts: list[np.ndarray], low: np.ndarray, width: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For pairs of an item and a text side by side: whether at most `most` edits turn the item into a stretch of the text, over alignments
    on the diagonals low .. low + width - 1 (text place less item place)."""
    size, n = np.array([len(x) for x in items]), np.array([len(x) for x in texts])
    longest, wide, far = int(size.max()), int(width.max()), int(most.max()) + 1
    own = np.full((len(items), longest), 0, np.uint32)
    other = np.full((len(items), longest + wide), 0, np.uint32)  # column x: the text's character at x + low
    for i, (item, text) in enumerate(zip(items, texts, strict=True)):
        own[i, : len(item)] = item + np.uint32(1)
        a, b = max(int(low[i]), 0), min(int(low[i]) + longest + wide, len(text))
        other[i, a - low[i] : max(b, a) - low[i]] = text[a : max(b, a)] + np.uint32(1)
    steps = np.arange(wide, dtype=np.int32)
    live, out = np.arange(len(items)), np.zeros(len(items), bool)
    end = low[:, None] + steps  # text characters used in a row
    inside = steps < width[:, None]
    row = np.where(inside & (end >= 0) & (end <= n[:, None]), 0, far).astype(np.int32)  # the stretch may begin anywhere
    for i in range(longest):
        end = low[live, None] + steps + (i + 1)
        no = ~inside[live] | (end < 0) | (end > n[live, None])
        new = row + np.where(end >= 1, other[live, i : i + wide] != own[live, i : i + 1], far)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)  # an item character is dropped
        new[no] = far
        new = np.minimum.accumulate(new - steps, 1) + steps  # text characters are put in
        new[no] = far
        row = np.minimum(new, far)
        least = row.min(1)
        ends = size[live] == i + 1
        out[live[ends]] = least[ends] <= most[live[ends]]
        stay = ~ends & (least <= most[live])
        if not stay.all():
            live, row = live[stay], row[stay]
            if not len(live):
                break
    return out


def aligned(pairs: list[tuple[np.ndarray, np.ndarray, int, int]]) -> list[bool]:
    """banded() of (item, text, first diagonal, edits), so many at a time that their cells are bounded."""
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][0]))
    out, held = [False] * len(pairs), []
    for k in [*order, None]:
        cells = 0 if k is None else len(pairs[k][0]) + 2 * (pairs[k][3] + 1)
        if held and (k is None or (len(held) + 1) * cells > CELLS):
            items, texts, low, edits = zip(*(pairs[h] for h in held), strict=True)
            for h, ok in zip(held, banded(list(items), list(texts), np.array(low), 2 * (np.array(edits) + 1), np.array(edits)).tolist(), strict=True):
                out[h] = ok
            held = []
        if k is not None and cells > LONG:
            item, text, low, edits = pairs[k]
            out[k] = long_banded(item, text, low, 2 * (edits + 1), edits)
        elif k is not None:
            held.append(k)
    return out


def in_order(ids: set[int | None]) -> list[int | None]:
    return sorted(ids, key=lambda k: (k is None, k or 0))


def contamination(texts: list[str | None], blocks: list[Block]) -> list[list[int]]:
    """Sorted item ids found in each text, those of items without one last."""
    plains = [plain(t) for t in texts]
    start = np.cumsum([0, *(len(t) + 1 for t in plains)])[:-1]
    chars = narrow("\n".join(plains))  # a plain text and an item hold no line end, so no shared q-gram crosses one
    found: list[set[int]] = [set() for _ in texts]
    for block in blocks:
        regions, most = block.regions(chars, start).tolist(), 1
        while regions:
            # The fullest bands of each text and item that is left; the others wait.
            chosen, later, taken = [], [], Counter()
            for region in regions:
                taken[region[0], region[1]] += 1
                (chosen if taken[region[0], region[1]] <= most else later).append(region)
            most *= 32
            pairs = []
            for text, item, low in chosen:
                edits, words_ = int(block.edits[item]), block.long[item][1]
                first = max(low - edits, 0)  # the part of the text that the band can reach
                pairs.append((codes(words_), codes(plains[text][first : max(low + 3 * (edits + 1) + len(words_), 0)]), low - first, edits))
            hit = {(text, item) for (text, item, _), ok in zip(chosen, aligned(pairs), strict=True) if ok}
            for text, item in hit:
                found[text].add(block.long[item][0])
            regions = [r for r in later if (r[0], r[1]) not in hit]
        for name, words_ in block.short:
            for text, body in enumerate(plains):
                if words_ in body:
                    found[text].add(name)
    return [in_order(x) for x in found]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Blocks of items of at most BLOCK_CHARS characters (one longer item is a block), read one
    after the other."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        text = plain(r["text"])
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, name: str = "items") -> DataFrame:
    """docs with the column `name`, the sorted ids of the benchmark items found in each text. One more
    Python step a block of items."""
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.drop(name).withColumn(name, F.array().cast("array<bigint>"))
    schema = out.schema
    for content in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(content)  # at most BLOCK_CHARS characters

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = Block(shared.value)
            for batch in batches:
                for rows in slices(batch):
                    new = contamination(rows["text"].to_pylist(), [block])
                    old = rows[name].to_pylist()
                    both = pa.array([in_order({*a, *b}) for a, b in zip(old, new, strict=True)], pa.list_(pa.int64()))
                    rows = rows.set_column(rows.schema.get_field_index(name), name, both)
                    yield from rows.combine_chunks().to_batches()

        out = out.mapInArrow(run, schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text holds no benchmark item, columns as they were."""
    return find(docs, benchmark, "__items").where(F.size("__items") == 0).drop("__items")
