"""Operator 4: language identification by compression.

For each language, text of known rows becomes a zstandard raw-content dictionary. A text is
encoded with every dictionary and gets the language of the smallest code; a narrow margin between
the two smallest marks the answer as rejected (the best guess stays in lang_pred).

Cases: a null text, or one without a letter, is `und`; ties go to the language with most training
rows, then by name; whole texts are encoded, in pieces; repeated rows are judged one by one;
a row without an id is neither held out nor learned from; without training rows every text is `und`; an empty table gives an empty result; further columns
are not read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import piece_of, small_batches

#: Dictionary bytes of a language, training rows of a language, characters taken of one row: the
#: bounds of the sample that the dictionaries are made of.
DICTIONARY, TRAIN_ROWS, TRAIN_CHARS = 96 << 10, 200, 1500
#: Characters encoded at once; margin (share of the smallest code) under which a text is rejected.
PIECE, MARGIN = 16_384, 0.01
LEVEL = 9
UNKNOWN = "und"

#: Numbers that aren't decimal digits, such as fractions, are word characters, but no letters.
_NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha())
_NOT_LETTERS = re.compile(rf"[\W\d_{_NUMBERS}]+")
_NOT_WORDS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case words of letters, joined by a space."""
    plain = _NOT_WORDS.sub(" ", text) if text else ""
    # The long class of numbers is slow on each character; only texts that hold such numbers need it.
    if not plain.isascii() and not plain.replace(" ", "").isalpha():
        plain = _NOT_LETTERS.sub(" ", text)
    return plain.strip().lower()


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def dictionaries(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(language, dictionary), most frequent first, from the rows of docs(doc_id, text, lang)."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int((1 << 30) * min(1.0, TRAIN_ROWS / n))))]) if counts else F.create_map(F.lit(""), F.lit(0))
    marked = known.withColumn("hash", F.xxhash64("doc_id", "text", F.lit(11)))
    sample = marked.where(F.pmod("hash", F.lit(1 << 30)) < F.get(F.array(F.element_at(share, F.col("lang"))), F.lit(0)))
    # Copies of a row share a hash and count once; what is left is about TRAIN_ROWS a language.
    sample = sample.dropDuplicates(["lang", "hash"]).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("place") <= TRAIN_ROWS)
    got: dict[str, list[tuple[int, str]]] = {k: [] for k in counts}
    # A piece from anywhere in the whole text, by a hash of its own.
    for r in sample.select("hash", "lang", piece_of(F.col("text"), F.xxhash64("hash", F.lit(13)), TRAIN_CHARS).alias("text")).collect():
        got[r["lang"]].append((r["hash"], letters(r["text"])))
    order = sorted(counts, key=lambda k: (-counts[k], k))
    return [(k, filled(list(dict.fromkeys(t for _, t in sorted(got[k]) if t)))) for k in order]


def filled(texts: list[str], room: int = DICTIONARY) -> bytes:
    """The texts in their order; where they don't fit, each has an equal share, and what shorter ones leave goes to the
    others. The places of the cuts go from the heads of the first texts to the ends of the last."""
    made, left, share = [t.encode() for t in texts], room, room
    for i, n in enumerate(sorted(len(t) + 1 for t in made)):
        share = left // (len(made) - i)
        if n > share:
            break
        left -= n
    else:
        share = room
    size, last = max(share - 1, 0), max(len(made) - 1, 1)
    at = [max(len(t) - size, 0) * i // last for i, t in enumerate(made)]
    return b" ".join(t[a : a + size].decode(errors="ignore").encode() for a, t in zip(at, made, strict=True))


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, languages: list[tuple[str, bytes]], margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1: how much smaller the best code is than the
    next) and rejected, for docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(languages)  # DICTIONARY bytes for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, coders = [], []
        for name, content in shared.value:
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            made.precompute_compress(level=LEVEL)
            names.append(name)
            coders.append(zstandard.ZstdCompressor(dict_data=made, write_content_size=False, write_dict_id=False))
        for batch in batches:
            preds, scores = [], []
            for text in batch.column("text").to_pylist():
                plain = letters(text)
                if not plain or not names:
                    preds.append(UNKNOWN), scores.append(0.0)
                    continue
                sizes = [0] * len(names)
                for i in range(0, len(plain), PIECE):
                    piece = plain[i : i + PIECE].encode()
                    for k, coder in enumerate(coders):
                        sizes[k] += len(coder.compress(piece))
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
                preds.append(names[best]), scores.append(1 - sizes[best] / second)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array([s < margin for s in scores])], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, SCHEMA)


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict all."""
    return identify(docs, dictionaries(docs.where(fold(F.col("doc_id")) != 2)))
