"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing column names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from veracity.llm import decontaminate, language, neardup, pieces, pii, quality, rules, substring, suffix, warc
from veracity.llm.common import grams, word_hashes, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice(["the", "tion", "er", "an", "é", "ß", "ou"]) for _ in range(rnd.randint(1, 4))) for _ in range(300)]
    make = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    shared = [make(70), make(55), make(30)]
    texts: list[str | None] = [None, "", " \n\t ", "x", make(4), "a" * 400, "ab" * 300, make(3000)]
    while len(texts) < n:
        t = make(rnd.randint(1, 200))
        if rnd.random() < 0.4:
            t += "\n" + rnd.choice(shared) + " " + make(rnd.randint(0, 20))
        texts.append(t)
    texts += [texts[9], texts[9], texts[10] + " end", "z " + texts[11], texts[7], " ".join(texts[12].split()[:-1])]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None]), len(t or "")) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def removed(units: dict[int, list], window: int) -> dict[int, list[bool]]:
    """Which units some window covers that also starts in a smaller id."""
    least: dict[tuple, int] = {}
    for d in sorted(units):
        for i in range(len(units[d]) - window + 1):
            least.setdefault(tuple(units[d][i : i + window]), d)
    out = {}
    for d, u in units.items():
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if least[tuple(u[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out[d] = gone
    return out


def test_grams_and_words():
    codes = np.arange(1, 40, dtype=np.uint64) * np.uint64(7919)
    for k in (1, 2, 3, 5, 8, 13, 16, 39):
        base = 0x9E3779B97F4A7C15
        want = [sum(int(c) * base ** (k - 1 - j) for j, c in enumerate(codes[i : i + k])) % 2**64 for i in range(len(codes) - k + 1)]
        assert grams(codes, k).tolist() == want
    raw = np.frombuffer(b"ab cab\x0bd", np.uint8)
    start, end, doc = words(raw, np.array([0, 4, 4, 8]))
    assert [bytes(raw[a:b]) for a, b in zip(start, end, strict=True)] == [b"ab", b"c", b"ab", b"d"] and doc.tolist() == [0, 0, 2, 2]
    h = word_hashes(raw, start, end)
    assert h[0] == h[2] and len(set(h.tolist())) == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed)
    found = by_id(suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    units = {i: list((t or "").encode()) for i, t, *_ in rows}
    for d, gone in removed(units, suffix.WINDOW).items():
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(units[d], gone, strict=True) if not g)
        assert found[d] == (len(gone), sum(gone), runs, hashlib.sha256(kept).hexdigest()), d


def test_suffix_order_survives_collisions(monkeypatch):
    """With a hash that calls everything equal, the verification settles the classes on the bytes."""
    rnd = np.random.default_rng(0)
    rows = rnd.integers(97, 99, (40, suffix.WIDTH), dtype=np.uint8)
    rows[20:] = rows[:20]
    row, at, cell = np.arange(40), np.zeros(40, np.int64), np.zeros(40, np.int64)
    want = [suffix.suffix_classes(rows, row, at, cell)[i] for i in range(40)]
    assert all(want[i] == want[i + 20] for i in range(20)) and len(set(want)) == 20
    monkeypatch.setattr(suffix.PrefixHashes, "part", lambda self, r, a, n: np.zeros(len(r), np.uint64))
    got = suffix.suffix_classes(rows, row, at, cell)
    assert all(got[i] == got[i + 20] for i in range(20)) and len(set(got.tolist())) == 20


def test_suffix_hot_anchors(spark):
    """A line that most documents share, before different text, in more blocks than the hot bound."""
    rnd = random.Random(5)
    line = "this very line of more than fifty bytes stands in most documents."
    rows = [(i, line + "".join(rnd.choice("abcdefgh ") for _ in range(80)), "en", "a", 0) for i in range(300)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        found = by_id(suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA)), "n_removed")
        words_found = by_id(substring.remove_repeats(spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60)) + f" own{i}", "en", "a", 0) for i in range(300)], SCHEMA)), "n_removed")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = removed({i: list(t.encode()) for i, t, *_ in rows}, 50)
    assert {d: sum(g) for d, g in want.items()} == {d: n for d, (n,) in found.items()}
    assert words_found == {i: (60 if i else 0,) for i in range(300)}


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(spark, batches):
    rows = corpus(3)
    found = by_id(substring.remove_repeats(spark.createDataFrame(rows, SCHEMA), batches), "n_words", "n_removed", "kept_sha256")
    units = {i: (t or "").encode().split() for i, t, *_ in rows}
    for d, gone in removed(units, substring.WINDOW).items():
        kept = b" ".join(w for w, g in zip(units[d], gone, strict=True) if not g)
        assert found[d] == (len(gone), sum(gone), hashlib.sha256(kept).hexdigest()), d


def test_substring_index_compacts(spark):
    rows = corpus(4, 80)
    index = substring.FingerprintIndex(spark)
    found = {}
    for k in range(6):
        part = [r for r in rows if r[0] * 6 // len(rows) == k]
        found |= by_id(index.add(spark.createDataFrame(part, SCHEMA)), "n_removed")
    assert len(index.runs) < 6
    want = removed({i: (t or "").encode().split() for i, t, *_ in rows}, substring.WINDOW)
    assert {d: n for d, (n,) in found.items()} == {d: sum(g) for d, g in want.items()}


def shingle_counts(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_near_dedup(spark):
    rows = corpus(6)
    base = "one " + " ".join(f"w{i}" for i in range(200))
    rows += [(1000 + i, base.replace(f"w{10 * i} ", f"changed{i} "), "en", "a", 0) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = by_id(neardup.near_classes(df), "class_id")
    bags = {i: shingle_counts(t) for i, t, *_ in rows}
    parent = {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b] and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    assert {d: c for d, (c,) in found.items()} == {d: root(d) for d in bags}
    left = neardup.deduplicate(df)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {d for d in bags if root(d) == d}


def test_dart_agreement():
    """Two weighted sets agree at about their similarity's share of coordinates."""
    rnd = np.random.default_rng(3)
    agree, n = 0, 60
    for _ in range(n):
        pool = rnd.integers(1, 2**62, 120, dtype=np.uint64)
        a, b = np.concatenate([pool[:100], pool[:40]]), np.concatenate([pool[20:], pool[20:60]])
        s = neardup.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2)
        agree += (s[0] == s[1]).mean()
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    assert abs(agree / n - sum((ca & cb).values()) / sum((ca | cb).values())) < 0.03


def test_pii_base(spark, docs):
    text = "mail a.b+c@x-y.org, x@y 1.2.3.4 1.2.3.256 card 4111 1111 1111 1111 or 4111111111111112, +1 (743) 555-3824 +12 3é 10.0.0.1.5 é@é a@b.c@d.e"
    base = pii.base_spans(text)
    for kind in pii.KINDS:
        pattern = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if kind == "ip" else pii.PATTERNS[kind]
        want = [(m.start(), m.end()) for m in pattern.finditer(text) if pii.holds(kind, m.group())]
        assert [(a, b) for a, b, k in base if k == kind] == want, kind
    rnd = random.Random(1)
    for _ in range(3000):
        t = "".join(rnd.choice("a1@.-+ ()%0") for _ in range(rnd.randint(0, 40)))
        assert pii.emails(t) == [m.span() for m in pii.PATTERNS["email"].finditer(t)], t
        ips = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
        assert [m.span() for m in pii.PATTERNS["ip"].finditer(t)] == [m.span() for m in ips.finditer(t)], t
    found = by_id(pii.find(docs, pii.train(docs)), "n_email", "base_sha256", "spans")
    assert len(found) == docs.count() and all(v == (0, hashlib.sha256(b"").hexdigest(), "") for v in found.values())
    long = "1" * 200_000 + " " + "." * 200_000 + "@" + "a" * 100_000
    assert pii.base_spans(long) == []


def test_pii_field_adds_lost_cards():
    rnd = random.Random(2)

    def card():
        head = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
        return next(head + c for c in "0123456789" if pii.luhn(head + c))

    texts = [f"pay with {card()} now, call +1 (212) 555-{rnd.randint(1000, 9999)} or room {rnd.randint(1, 99)}" for _ in range(80)]
    field = pii.Field.fit(texts)
    number = card()
    text = f"first {number} then {number} {number} and room 12"
    base = pii.base_spans(text)
    assert [k for *_, k in base] == ["card"]
    more = field.further(text, base)
    assert [(text[a:b], k) for a, b, k in more] == [(number, "card")] * 2
    assert pii.redacted(text, [*base, *more]) == "first <card> then <card> <card> and room 12"


def test_quality_and_rules(spark, none):
    rnd = random.Random(3)
    good = [" ".join("".join(rnd.choice("aeioustrnl") for _ in range(rnd.randint(2, 8))) for _ in range(120)) + "." for _ in range(60)]
    bad = [" ".join("".join(rnd.choice("aeioustrnl") for _ in range(5)) + rnd.choice(["&&&", "###", "%%%"]) for _ in range(120)) for _ in range(40)]
    rows = [(i, t, "en", "a" if i % 3 else None, 0) for i, t in enumerate([*good, *bad, None, "", good[0], "x y", "q " * 200])]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "kept")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 100, 2)] + [(3, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    out = by_id(quality.classify(df, labels), "kept")
    assert all(out[i] == (i < 60,) for i in range(100)) and len(out) == len(rows)
    assert quality.classify(none, labels).count() == 0 and quality.classify(df, labels.limit(0)).count() == len(rows)
    got = by_id(rules.quality_rules(df, labels), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t, *_ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        count = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        twice = {k + o for k in range(len(w) - 2) if count[tuple(w[k : k + 3])] > 1 for o in range(3)}
        failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
        assert got[i][:6] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), 0, len(twice), failed)
        assert got[i][6] == (i < 60 or i == 102) or i > 102
    assert rules.repeated_lines("a\n\n\na\n b\n b\na") == 3
    assert rules.quality_rules(none, labels).count() == 0


def test_language(spark, none):
    rnd = random.Random(4)
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["schaft", "ung", "ich", "ei"], "cc": ["mente", "ción", "ado", "os"]}
    rows = [(i, " ".join("".join(rnd.choice(parts[k]) for _ in range(rnd.randint(1, 4))) for _ in range(60)), k, "s", 0) for i, k in enumerate(sorted(parts) * 40)]
    rows += [(500, None, "aa", "s", 0), (501, "12 34 --", "bb", "s", 0), (502, "", None, None, None)]
    found = by_id(language.language_id(spark.createDataFrame(rows, SCHEMA)), "held_out", "lang_pred", "score")
    held = [(found[i][1], k) for i, _, k, *_ in rows[:-3] if found[i][0]]
    assert len(held) > 15 and sum(a == b for a, b in held) == len(held)
    assert [found[i][1] for i in (500, 501, 502)] == ["und"] * 3 and all(0 <= s <= 1 for *_, s in found.values())
    assert language.language_id(none).count() == 0


def test_decontaminate(spark, docs, none):
    rnd = random.Random(5)
    make = lambda k: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(k))
    items = [(i, make(30)) for i in range(8)] + [(20, "short q"), (21, None), (22, ""), (23, "\n "), (24, make(3))]

    def edited(t, n):
        t = list(t)
        for _ in range(n):
            p = rnd.randrange(len(t))
            t[p : p + 1] = rnd.choice(["", "z", t[p] + "z"])
        return "".join(t)

    def distance(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    rows = [(0, make(40), "en", "a", 1), (1, None, "en", "a", 1), (2, "see  SHORT\nQ here", "en", "a", 1)]
    for i in range(8):
        for n in (0, 5, 15, 30):
            rows.append((10 * i + n + 3, make(20) + " " + edited(items[i][1], n).upper() + "\n" + make(10), "en", "a", 1))
    rows.append((999, items[0][1] + " " + items[3][1], "en", "a", 1))
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r["text"]: r["found"] for r in decontaminate.find(df, bench, "found").collect()}
    for _, t, *_ in rows:
        body = decontaminate.plain(t)
        want = []
        for i, item in items:
            item = decontaminate.plain(item)
            if item and (item in body if len(item) < decontaminate.Q else distance(item, body) <= decontaminate.budget(len(item))):
                want.append(i)
        assert found[t] == want, t
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not v for v in found.values())
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == len(rows) and decontaminate.find(none, bench).count() == 0


def test_pieces_equal_the_library(spark, docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    extra = ["", None, " ", "  two  spaces ", "日本語 🎉🎉\ttab", "x" * 3000, "\n\n", "    deep\n        more", "the the THE's ((x))"]
    df = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    rows = pieces.decode(pieces.encode(df)).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert r["pieces"] == (None if r["text"] is None else sp.encode(r["text"])) and r["decoded"] == r["text"]
    assert pieces.encode(none).count() == 0
    assert sorted(map(repr, pieces.round_trip(df).collect())) == sorted(map(repr, rows))


def test_warc(spark, tmp_path):
    import base64

    rows = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 5000), (0, "u", "only"), (7, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n"), (8, "u", "\r\n"), (9, "u", "<p>é</p>"), (9, "u", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "archive")
    warc.write_archive(pages, path)
    archive = warc.read_archive(spark, path)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["digest_ok"]) for r in warc.described(archive).collect())
    first: dict[bytes, int] = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        first.setdefault((h or "").encode(), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first[b]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == i else "revisit", None if f == i else f, True))
    assert sorted(got) == sorted(want)
    assert spark.read.parquet(f"{path}/payloads").count() == len(first)
    warc.export_warc(archive, str(tmp_path / "warc"))
    text = b"".join(__import__("gzip").decompress(p.read_bytes()) for p in sorted((tmp_path / "warc").glob("*.gz")))
    assert text.count(b"\r\nWARC-Record-ID: ") == len(rows) and b"x" * 5000 + b"\r\n\r\n" in text
    files = warc.import_warc(spark, str(tmp_path / "warc")).cache()
    again = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["digest_ok"]) for r in warc.described_files(files).collect())
    assert again == sorted(want)
    stored = {(r["page_id"], r["header"]): bytes(r["payload"]) for r in archive.collect()}
    assert all(bytes(r["payload"]) == (b"" if "WARC-Type: revisit" in r["header"] else stored[r["page_id"], r["header"]]) for r in files.collect())
    empty = str(tmp_path / "none")
    warc.write_archive(pages.limit(0), empty)
    assert warc.described(warc.read_archive(spark, empty)).count() == 0


def test_null_ids(spark):
    rows = [(None, "a b c " * 40, "en", "a", 1), (1, "a b c " * 40, "en", "a", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert suffix.remove_repeats(df).count() == 3 and substring.remove_repeats(df).count() == 3
    assert neardup.deduplicate(df).count() == 3 and pii.find(df, pii.train(df)).count() == 3 and language.language_id(df).count() == 3


@pytest.mark.parametrize("op", [suffix.remove_repeats, substring.remove_repeats, neardup.near_classes, neardup.deduplicate])
def test_empty_tables(none, op):
    assert op(none).count() == 0
