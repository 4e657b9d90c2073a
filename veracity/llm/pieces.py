"""Operator 9: SentencePiece encoding and decoding by a forward pass over shared prefixes.

A text is cut into marked words (a run of the space mark and what follows it, or a character that no
piece joins to others). The distinct words of a slice of texts are sorted, which lays out their
trie, and walked depth-first: forward states are kept for the characters that a word shares with
the one before it and computed only for the rest.

For a unigram model the state of a prefix is the best score (Viterbi). For a BPE model the best sum of scores is
not what its merges give; there a prefix keeps the one last piece whose pairing with the piece
before it survives merging, which gives the merges' own result. Unknown characters become
byte pieces where the model has them.

Cases: a null text stays null, an empty text has no pieces; a very long text is encoded whole, in a slice of its own; ids aren't read; of
paths with equal scores the one with the longer last piece counts; U+2581 in a text reads as a space, as in
the model's own normalisation; repeated rows are encoded one by one; an empty table gives an empty
result; further columns pass through, those named like results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, small_batches

#: Where the public vocabulary files lie, unless given.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words (of each of two generations) and piece pairs that a Python worker remembers.
WORD_CACHE, PAIR_CACHE = 200_000, 500_000


class Coder:
    """Encoder and decoder of one model file's bytes."""

    def __init__(self, content: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(content)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        self.bpe, self.prefix = proto.trainer_spec.model_type == 2, norm.add_dummy_prefix
        sp = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.score, self.id, self.byte, self.bytes = {}, {}, {}, []
        self.unknown = sp.unk_id()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unused(i):
                self.bytes.append(b"")
            elif sp.is_unknown(i):
                self.bytes.append(" ⁇ ".encode())
            else:
                self.id[piece], self.score[piece] = i, sp.get_score(i)
                self.bytes.append(piece.replace(MARK, " ").encode())
        self.unknown_score = min(self.score.values(), default=0.0) - 10
        # Every suffix of a piece: its score if it is a piece that merging itself gives, else None.
        self.endings: dict[str, float | None] = {p[i:]: None for p in self.id for i in range(len(p))}
        self.endings.update((p, v) for p, v in self.score.items() if not self.bpe or self.merged(p) == [p])
        crossing = {c for p in self.id for c in p[1:] if len(p) > 1} | {p[0] for p in self.id if len(p) > 1}
        self.marked_inside = any(MARK in p.lstrip(MARK) for p in self.id)
        single = "".join(c for c in "\n\r\t\v\f" if c not in crossing)
        other = re.escape(single)
        self.cut = re.compile(f"{MARK}*[^{MARK}{other}]+|{MARK}+" + (f"|[{other}]" if single else ""))
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The merges of a short text, done one by one: best score first, then leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[parts[i] + parts[i + 1]], -i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.score), default=None)
            if best is None:
                break
            parts[-best[1] : 2 - best[1]] = [parts[-best[1]] + parts[1 - best[1]]]
        return parts

    def together(self, left: str, right: str) -> bool:
        """Whether merging leaves these two neighbours as they are."""
        if len(self.pairs) >= PAIR_CACHE:
            self.pairs.clear()
        known = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return known

    def ids(self, piece: str) -> list[int]:
        i = self.id.get(piece)
        if i is not None:
            return [i]
        raw = piece.encode("utf-8", "surrogatepass")
        return [self.byte[b] for b in raw] if self.byte else [self.unknown]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Piece ids (int32 bytes) of each of the sorted distinct words, by one walk of their trie."""
        out, before = {}, ""
        back, total, pieces = [0], [0.0], [""]  # for each prefix: start, score and text of its last piece
        endings, pairs, together, bpe = self.endings, self.pairs, self.together, self.bpe
        for word in words:
            same = 0
            for a, b in zip(before, word):  # noqa: B905
                if a != b:
                    break
                same += 1
            del back[same + 1 :], total[same + 1 :], pieces[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                # An unknown character stands alone; a piece goes back as far as some piece ends so.
                start, chosen = end - 1, word[end - 1]
                if bpe:
                    best = None if chosen in endings else total[start] - 1e6
                else:
                    best = total[start] + self.unknown_score if endings.get(chosen) is None else None
                for j in range(end - 1, -1, -1):
                    piece = word[j:end]
                    value = endings.get(piece, 0)
                    if value is None:
                        continue
                    if not value and piece not in endings:
                        break
                    if bpe:
                        known = not j or pairs.get((pieces[j], piece))
                        if known or known is None and together(pieces[j], piece):
                            start, best, chosen = j, total[j] + value, piece
                            break
                    elif best is None or total[j] + value >= best:
                        start, best, chosen = j, total[j] + value, piece
                back.append(start), total.append(total[start] if best is None else best), pieces.append(chosen)
            found, at = [], len(word)
            while at:
                found.append(pieces[at])
                at = back[at]
            out[word] = np.array([i for p in reversed(found) for i in self.ids(p)], np.int32).tobytes()
            before = word
        return out

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """The piece ids of each text, as int32 bytes."""
        cut = self.cut.findall
        parts = [None if t is None else cut((MARK if self.prefix and t else "") + t.replace(" ", MARK)) for t in texts]
        words = {w for p in parts if p for w in p}
        known = {w: x for w in words if (x := self.words.get(w) or self.older.get(w)) is not None}
        known.update(self.encode_words(sorted(words - known.keys())))
        self.words.update((w, x) for w, x in known.items() if len(w) < 64)
        if len(self.words) > WORD_CACHE:  # words not met for a whole generation are forgotten
            self.older, self.words = self.words, {}
        joined = [None if p is None else b"".join(map(known.__getitem__, p)) for p in parts]
        return joined if self.byte else [x and self.one_unknown(x) for x in joined]

    def one_unknown(self, ids: bytes) -> bytes:
        """Neighbouring unknown characters as one piece."""
        found = np.frombuffer(ids, np.int32)
        unknown = found == self.unknown
        unknown[1:] &= unknown[:-1].copy()
        unknown[:1] = False
        return found[~unknown].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_coders: dict[int, Coder] = {}


def coder(content: bytes) -> Coder:
    """One coder a model and Python worker, so that its memory of words lasts."""
    key = hash(content)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(content)
    return _coders[key]


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def round_trip(docs: DataFrame, model: str = MODEL, column: str = "text", out: str = "pieces", decoded: str = "decoded") -> DataFrame:
    """encode() and decode() in one step, so that a task has one Python worker and the ids stay in it."""
    return encode(docs.drop(decoded), model, column, out, decoded)


def encode(docs: DataFrame, model: str = MODEL, column: str = "text", out: str = "pieces", decoded: str | None = None) -> DataFrame:
    """docs with the array of piece ids of `column`, and, if named, the text that they decode to. The driver reads the
    model file (under 1 MB) and sends it to the executors."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model_bytes(model))
    base = docs.drop(out)
    schema = T.StructType([*base.schema, T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(shared.value)
        for batch in batches:
            for rows in slices(batch, column):
                found = code.encode(rows[column].to_pylist())
                lengths = np.array([0 if x is None else len(x) // 4 for x in found])
                # A list whose offset is null is null.
                offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32(), mask=np.array([x is None for x in found] + [False]))
                values = pa.array(np.frombuffer(b"".join(x for x in found if x), np.int32))
                rows = rows.append_column(out, pa.ListArray.from_arrays(offsets, values))
                if decoded:
                    rows = rows.append_column(decoded, pa.array([None if x is None else code.decode(np.frombuffer(x, np.int32)) for x in found], pa.string()))
                yield from rows.combine_chunks().to_batches()

    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL, column: str = "pieces", out: str = "decoded") -> DataFrame:
    """encoded with the text of its array of piece ids."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(model_bytes(model))
    base = encoded.drop(out)
    schema = T.StructType([*base.schema, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(shared.value)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column))
            ids, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            texts = [code.decode(ids[a:b]) if ok else None for a, b, ok in zip(at[:-1], at[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return base.mapInArrow(run, schema)
