"""Marks and messages of operator 2: what recurs by chance asks for no contexts, whatever the size of the table."""

import random

import numpy as np
import pyarrow as pa
import pytest

from veracity.llm import blocks, suffix


def laid_out(texts, dealt=4):
    """Blocks of texts by turns, after their marks have met."""
    none = pa.schema(blocks._NOTES).empty_table()
    packs = []
    for b in range(dealt):
        ids = list(range(b, len(texts), dealt))
        packs.append(pa.chunked_array([[blocks.pack(pa.table({"doc_id": ids, "text": [texts[i] for i in ids]}, schema=blocks.TEXTS))]]))
    sent = pa.concat_tables([(t := suffix.Block(p, none).mark_packs(3)).append_column("blk", pa.array([b] * t.num_rows, pa.int32())) for b, p in enumerate(packs)])
    notes = pa.concat_tables([suffix.find_shared(sent.filter(pa.array(sent["bucket"].to_numpy() == i))) for i in set(sent["bucket"].to_pylist())])
    out = []
    for b, p in enumerate(packs):
        own = notes.filter(pa.array(notes["blk"].to_numpy() == b))
        out.append(suffix.Block(p, own))
        out[-1].choose(own, 3)
    return out, sent, notes


def test_words_that_recur_ask_for_no_contexts():
    """Texts of 40 words in any order: nearly every 16 bytes recur in another text, no 50 do."""
    rnd = random.Random(0)
    syllables = ["an", "the", "er", "on", "re", "ti", "in", "st", "ou", "nd"]
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3))) for _ in range(40)]
    texts = [" ".join(rnd.choice(words) for _ in range(400)) for _ in range(1000)]
    seen, again = {}, 0
    for i, t in enumerate(texts):
        for a in range(0, len(t) - 16, 7):
            again += seen.setdefault(t[a : a + 16], i) != i
    assert again > 0.3 * sum(len(t) / 7 for t in texts)
    found, _, _ = laid_out(texts)
    assert sum(len(b.key) for b in found) < 0.03 * sum(len(b.anchors.mark) for b in found)


def test_blocks_and_buckets_exchange_packed_rows():
    rnd = random.Random(1)
    line = "this very line of more than fifty bytes stands in most of the documents here. "
    texts = [line + "".join(rnd.choice("abcdefgh ") for _ in range(500)) for _ in range(200)]
    found, sent, notes = laid_out(texts)
    assert sent.num_rows == 12 and notes.num_rows <= 12
    assert all(len(b.key) and len(b.windows) >= 50 for b in found)
    # Each block has the line's contexts, and so does each document.
    assert set.intersection(*(set(b.key.tolist()) for b in found))
    assert sum(notes["b"].to_pylist()) >= sum(len(np.unique(b.key)) for b in found)


def test_a_mark_of_two_texts_in_one_block_is_shared():
    text = "only one block has these two texts, which say the same for more than fifty bytes"
    found, _, _ = laid_out([text + " first", "x" * 60, text + " second"], dealt=2)
    assert [len(set(b.doc.tolist())) for b in found] == [2, 0]


@pytest.mark.parametrize("same", [False, True])
def test_unique_rows_survives_collisions(monkeypatch, same):
    rows = np.random.default_rng(0).integers(0, 2, (500, 7), dtype=np.uint8)
    if same:
        monkeypatch.setattr(suffix, "row_hashes", lambda words: np.zeros(len(words), np.uint64))
    first, back = suffix.unique_rows(rows)
    assert (rows[first][back] == rows).all() and len(first) == len({r.tobytes() for r in rows})


def test_contexts_hold_their_windows_only():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abc ") for _ in range(300)) for _ in range(6)]
    block, _, _ = laid_out(texts * 2, dealt=1)
    block = block[0]
    assert len(block.key)
    raw = block.own.tobytes()
    for low, n, row in zip(block.low.tolist(), block.windows.tolist(), block.rows[block.entry], strict=True):
        held = raw[low : low + n + suffix.WINDOW - 1]
        assert row[: suffix.WIDTH].tobytes() == held.ljust(suffix.WIDTH, b"\0") and row[suffix.WIDTH + 1] == n


def test_covered_places():
    rnd = np.random.default_rng(3)
    for n in (50, 51, 400):
        for some in (0, 1, 3, 20):
            starts = rnd.integers(0, n - 49, some)
            want = np.zeros(n, bool)
            for a in starts:
                want[a : a + 50] = True
            assert (blocks.covered(starts, 50, n) == want).all()
    assert not blocks.covered(np.zeros(0, np.int64), 50, 0).size
