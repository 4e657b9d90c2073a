"""Operator 1: personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans, which always stay. The field labels the tokens (runs without
white space) that hold a digit or an @: neighbours in the text form a chain, and each token is also
tied to the last earlier token with the same string and to the last one of the same shape, so
that the links stay linear in the tokens. Unary weights and the potentials are learned from the base spans
of a bounded sample; loopy sum-product messages spread the labels over each document, and
tokens labelled with confidence that no base span touches become further spans.

Cases: a null or empty text has no spans; a text without candidates costs one scan; whole texts
are read, in time in proportion to their length; an id may be missing; of labels that are equally likely the first counts, and base spans of
one start are in the order of KINDS; repeated rows are judged one by one; an empty table gives an empty result; when text is
replaced, further columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import piece_of, slices, small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: The lookbehind of `ip` spares new starts inside a long run of digits; it changes no match, because
#: a match always takes all digits at its end.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Rows of the training sample, and characters that one of them gives; message rounds; confidence of a further span.
TRAIN_ROWS, TRAIN_TEXT, ROUNDS, SURE = 3000, 20_000, 8, 0.8

_WORD = re.compile(r"\S+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HAS = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_EDGE = "\"'()[]{}<>,;:!?.#*$%&|="


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def holds(kind: str, text: str) -> bool:
    """The check that a match of the pattern must pass."""
    if kind == "ip":
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in text.split(".")))
    if kind == "email":
        return True
    digits = _NOT_DIGIT.sub("", text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern in time linear in the text: from each @ back over its local part."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        done = found.end() if found else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; leftmost and non-overlapping for each kind."""
    if not text or not _HAS.search(text):
        return []
    out = []
    for rank, kind in enumerate(KINDS):
        if kind == "email":
            out += [(a, rank, b, kind) for a, b in emails(text)]
            continue
        out += [(m.start(), rank, m.end(), kind) for m in PATTERNS[kind].finditer(text) if holds(kind, m.group())]
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def tokens(text: str) -> list[tuple[int, int]]:
    """Candidate tokens, without punctuation at their edges."""
    out = []
    for m in _WORD.finditer(text):
        word = m.group()
        if not _HAS.search(word):
            continue
        left = len(word) - len(word.lstrip(_EDGE.replace("(", "")))
        right = len(word.rstrip(_EDGE.replace(")", "")))
        if right > left:
            out.append((m.start() + left, m.start() + right))
    return out


def shape(word: str) -> str:
    """Letters as a, digits as 0; runs of letters shortened."""
    return re.sub("a+", "a", re.sub("[0-9]", "0", re.sub(r"[^\W\d_]", "a", word)))


FEATURES = 22


def describe(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[str], list[str]]:
    """Feature rows, strings and shapes of the tokens."""
    strings = [text[a:b] for a, b in spans]
    shapes = [shape(w) for w in strings]
    x = np.zeros((len(spans), FEATURES))
    for i, (w, s) in enumerate(zip(strings, shapes, strict=True)):
        digits = sum(c.isdigit() for c in w)
        near = [i > 0 and spans[i - 1][1] + 2 >= spans[i][0], i + 1 < len(spans) and spans[i][1] + 2 >= spans[i + 1][0]]
        full = PATTERNS["card"].fullmatch(w) is not None
        x[i] = [
            1, "@" in w, bool(emails(w)), w.count(".") == 3, bool(PATTERNS["ip"].fullmatch(w)), bool(PATTERNS["ip"].fullmatch(w)) and holds("ip", w),
            digits == len(w), 14 <= digits <= 19, full and 14 <= digits <= 19, full and holds("card", w), w.startswith("+"), w.startswith("("), w.endswith(")"), bool(re.fullmatch(r"[0-9]{3}-[0-9]{4}", w)),
            "a" in s, digits <= 3, 4 <= digits <= 9, 10 <= digits <= 13, digits > 19, *near, "-" in w,
        ]
    return x, strings, shapes


def links(spans: list[tuple[int, int]], strings: list[str], shapes: list[str]) -> list[tuple[int, int, int]]:
    """(token, later token, sort): 0 chain, 1 same string, 2 same shape. At most three a token."""
    out = [(i, i + 1, 0) for i, (a, b) in enumerate(pairwise(spans)) if b[0] - a[1] <= 2]
    chained = {(i, j) for i, j, _ in out}
    for sort, keys in ((1, strings), (2, shapes)):
        last: dict[str, int] = {}
        for i, key in enumerate(keys):
            j = last.get(key)
            if j is not None and (j, i) not in chained:
                out.append((j, i, sort))
                chained.add((j, i))
            last[key] = i
    return out


def gold(text: str, spans: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> np.ndarray:
    """Labels of tokens from the base spans that cover a part of them; -1 (not learned from) for
    one that a pattern would take if it stood alone, and lost to what stands beside it."""
    y = np.zeros(len(spans), int)
    ends = [d for _, d in spans]
    for a, b, kind in reversed(base):
        i = bisect_right(ends, a)
        while i < len(spans) and spans[i][0] < b:
            y[i] = LABELS.index(kind)
            i += 1
    for i, (c, d) in enumerate(spans):
        if not y[i] and base_spans(text[c:d]):
            y[i] = -1
    return y


class Field:
    """unary: FEATURES x labels; pair: the potentials of the three sorts of links."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    @classmethod
    def fit(cls, texts: list[str], steps: int = 150) -> Field:
        n = len(LABELS)
        xs, ys, counts = [np.zeros((0, FEATURES))], [np.zeros(0, int)], np.ones((3, n, n))
        for text in texts:
            spans = tokens(text)
            if spans:
                x, strings, shapes = describe(text, spans)
                y = gold(text, spans, base_spans(text))
                xs.append(x[y >= 0]), ys.append(y[y >= 0])
                for i, j, sort in links(spans, strings, shapes):
                    if y[i] >= 0 <= y[j]:
                        counts[sort, y[i], y[j]] += 1
        x, y = np.concatenate(xs), np.concatenate(ys)
        w = np.zeros((FEATURES, n))
        if len(x):
            scale = np.bincount(y, minlength=n)
            weight = (1 / np.maximum(scale, 1) ** 0.5)[y]
            weight /= weight.sum()
            for _ in range(steps):
                p = np.exp(x @ w - (x @ w).max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                w -= 4 * (x.T @ (p * weight[:, None]) + 1e-4 * w)
        joint = counts / counts.sum((1, 2), keepdims=True)
        pair = np.log(joint / (joint.sum(2, keepdims=True) * joint.sum(1, keepdims=True)))
        # Ties to distant tokens are weak evidence each; labels only agree or not along them.
        pair = np.clip(pair, -2, 2) * np.array([0.5, 1, 0.5])[:, None, None]
        for sort in (1, 2):
            pair[sort] = np.where(np.eye(n, dtype=bool), np.maximum(pair[sort], 0.2), np.minimum(pair[sort], 0))
        return cls(w, pair)

    def marginals(self, x: np.ndarray, edges: list[tuple[int, int, int]]) -> np.ndarray:
        """Label probabilities by loopy sum-product, damped, a fixed number of rounds."""
        unary = x @ self.unary
        unary -= unary.max(1, keepdims=True)
        if edges:
            e = np.array(edges)
            source, target = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
            pot = np.concatenate([self.pair[e[:, 2]], self.pair[e[:, 2]].transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(e)) + len(e), np.arange(len(e))])
            message = np.zeros((2 * len(e), len(LABELS)))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, message)
                send = (belief[source] - message[back])[:, :, None] + pot
                top = send.max(1)
                new = np.log(np.exp(send - top[:, None]).sum(1)) + top
                new -= new.max(1, keepdims=True)
                message = 0.5 * message + 0.5 * new
            np.add.at(unary, target, message)
            unary -= unary.max(1, keepdims=True)
        p = np.exp(unary)
        return p / p.sum(1, keepdims=True)

    def further(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Spans of tokens that the field labels and no base span touches; neighbouring
        phone tokens are one span."""
        spans = tokens(text)
        if not spans:
            return []
        x, strings, shapes = describe(text, spans)
        p = self.marginals(x, links(spans, strings, shapes))
        out: list[tuple[int, int, str]] = []
        starts = [a for a, *_ in base]
        reach = list(accumulate((b for _, b, _ in base), max))
        for (a, b), row in zip(spans, p, strict=True):
            k, before = int(row.argmax()), bisect_left(starts, b)  # base spans that begin before b
            if not k or row[k] < SURE or before and reach[before - 1] > a:
                continue
            if out and LABELS[k] == "phone" == out[-1][2] and a - out[-1][1] <= 2:
                out[-1] = (out[-1][0], b, "phone")
            else:
                out.append((a, b, LABELS[k]))
        digits = lambda s: len(_NOT_DIGIT.sub("", text[s[0] : s[1]]))
        return [s for s in out if s[2] != "phone" or 7 <= digits(s) <= 15]


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in order)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_TEXT) -> Field:
    """Fit on a sample of at most `rows`, by a hash of id and text, of the rows that hold candidates; a longer text
    gives `chars` characters from anywhere."""
    some = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(5)).alias("hash")).where(F.col("text").rlike("[0-9@]"))
    share = rows / max(rows, some.count())
    chosen = some.where(F.pmod("hash", F.lit(1 << 20)) < int(share * (1 << 20))).orderBy("hash").limit(rows).select("doc_id", piece_of(F.col("text"), F.xxhash64("hash", F.lit(6)), chars).alias("text"))
    return Field.fit([r["text"] for r in sorted(chosen.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"]))])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_further long"


def find(docs: DataFrame, field: Field) -> DataFrame:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                more = field.further(text, base) if text and _HAS.search(text) else []
                rows.append([*(sum(k == kind for *_, k in base) for kind in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *more]), len(more)])
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_further"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redacted(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """Each span as <kind>; overlapping spans are one, named after the first."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs with the spans in `text` replaced, and `n_chars`, where there is one, counted anew."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            for rows in slices(batch):
                texts = []
                for text in rows["text"].to_pylist():
                    base = base_spans(text)
                    more = field.further(text, base) if text and _HAS.search(text) else []
                    texts.append(redacted(text, [*base, *more]))
                rows = rows.set_column(rows.schema.get_field_index("text"), "text", pa.array(texts, rows.schema.field("text").type))
                yield from rows.combine_chunks().to_batches()

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
