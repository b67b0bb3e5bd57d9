"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled to three machines, and a text's ids are the shortest path of their composition with it in the tropical
semiring (weights add along a path, the least path wins).

* The normaliser (:class:`Normaliser`): arcs from a character, or the longest key of the model's character map, to what it becomes;
  its two states tell whether a blank went before, so that blanks can be merged.
* The lexicon (:class:`Lexicon`): a tree of characters with a weight where a piece ends. A character that is no piece has an arc
  through its bytes (or the unknown piece), weighted as the library does.
* The filter (:class:`Filter`) weighs a piece after another. Unigram models have one state and no weight in it: their arcs weigh
  minus the score. Merge (BPE) models give the order of merges, not weights, so every piece weighs one and the filter
  adds infinity unless the merges of the two texts together end in exactly these two pieces.

That this is exact for merges: (a) the outcome of the merges is a path, as merges inside a stretch that no merge leaves run as if the
stretch stood alone; (b) a path is the outcome, as the first merge over one of its borders would also be the best one in the two
pieces alone. So each place has exactly one path of finite weight, a place needs one entry for both kinds of model, and
one routine (``_lightest_path``) serves both.

Composition is cut where it can branch no further: between characters that never stand together inside a piece. Stretches between
cuts are solved once per worker and remembered (bounded).

Defined results: null and empty texts have no ids; repeated rows are encoded each; only ``text`` is read; an empty
table gives an empty result. Decoding returns the normalised text, with the meta symbol as a blank.
Models with a damaged character map, user-defined or unused pieces, or blanks as suffixes are refused.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .shipping import ship

META = "▁"
#: Piece types of the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Stretches and words a Python worker remembers (each); the later half goes when full.
REMEMBERED = 350_000
#: Longer stretches and words are solved each time, so that what is remembered stays bounded.
LONGEST_REMEMBERED = 256


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + n]
            at += n


class Normaliser:
    """Text to normalised text: character arcs, those of the model's character map first, and two states for blanks.

    The map of the file format is a double array of bytes in 32-bit units (its size goes before it) and the zero-ended outputs."""

    def __init__(self, prefix: bool, squeeze: bool, charmap: bytes):
        self.prefix, self.squeeze = prefix, squeeze
        self.units, self.outputs = np.zeros(0, "<u4"), b""
        if charmap:
            size = int.from_bytes(charmap[:4], "little")
            if len(charmap) < 8 or size % 4 or not 0 < size <= len(charmap) - 4:
                raise ValueError("a damaged character map")
            self.units, self.outputs = np.frombuffer(charmap[4 : 4 + size], "<u4"), charmap[4 + size :]
        self.table = self.units.tolist()
        self.starts: dict[str, bool] = {}

    @staticmethod
    def _first(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def arc(self, text: str, at: int) -> tuple[str, int]:
        """(output, next place) of the longest key at a place; without one the character stays as it is."""
        table, node, n = self.table, self._first(self.table[0]) if self.table else 0, at
        found: tuple[str, int] | None = None
        while table and n < len(text):
            for byte in text[n].encode("utf-8", "replace"):
                node ^= byte
                if node >= len(table) or table[node] & 0x800000FF != byte:
                    return found or (text[at], at + 1)
                unit = table[node]
                node ^= self._first(unit)
            n += 1
            if unit >> 8 & 1:
                out = table[node] & 0x7FFFFFFF
                found = self.outputs[out : self.outputs.index(b"\0", out)].decode(), n
        return found or (text[at], at + 1)

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        if self.table:
            out, at = [], 0
            while at < len(text):
                c = text[at]
                if c not in self.starts:  # does any key begin with it?
                    self.starts[c] = self._begins(c)
                made, at = self.arc(text, at) if self.starts[c] else (c, at + 1)
                out.append(made)
            text = "".join(out)
        if self.squeeze:
            text = " ".join(w for w in text.split(" ") if w)
        text = (META if self.prefix else "") + text.replace(" ", META)
        return text.rstrip(META) if self.squeeze else text

    def _begins(self, c: str) -> bool:
        node = self._first(self.table[0])
        for byte in c.encode("utf-8", "replace"):
            node ^= byte
            if node >= len(self.table) or self.table[node] & 0x800000FF != byte:
                return False
            node ^= self._first(self.table[node])
        return True


class Lexicon:
    """Tree of characters: ``arcs[state]`` leads on, ``final[state]`` is the weight of the piece that ends there."""

    def __init__(self, weights: dict[str, float], other: float):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[float] = [math.inf]
        self.other = other
        for piece, weight in weights.items():
            state = 0
            for c in piece:
                after = self.arcs[state].get(c)
                if after is None:
                    after = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(math.inf)
                state = after
            self.final[state] = weight

    def leaving(self, text: str, at: int) -> Iterator[tuple[int, float]]:
        """(end, weight) of every piece of ``text`` that starts at a place; a character without a piece has its byte arc."""
        state: int | None = 0
        for end in range(at + 1, len(text) + 1):
            state = self.arcs[state].get(text[end - 1])
            if state is None:
                if end == at + 1:
                    yield end, self.other
                return
            weight = self.final[state]
            if weight < math.inf:
                yield end, weight
            elif end == at + 1:
                yield end, self.other


class Filter:
    """Weight of a piece after another one: 0 or infinity. States are the pieces, expanded as they are met and remembered (bounded)."""

    def __init__(self, scores: dict[str, float], remembered: int):
        self.scores, self.remembered = scores, remembered
        self.known: dict[tuple[str, str], float] = {}

    def merges(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scored adjacent pair joins first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def weight(self, left: str, right: str) -> float:
        """An empty ``left`` asks whether merges make the piece at all."""
        key = (left, right)
        known = self.known.get(key)
        if known is None:
            if len(self.known) > 4 * self.remembered:
                self.known.clear()
            known = self.known[key] = 0.0 if self.merges(left + right) == ([left, right] if left else [right]) else math.inf
        return known


class Transducer:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0)
                self.types.append(f.get(3, NORMAL))
            elif number == 2:
                trainer.update(_fields(value))  # later settings go over earlier ones, as in the file format
            elif number == 3:
                normaliser.update(_fields(value))
        self.kind, self.fallback, suffix = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(trainer.get(24, 0))
        self.prefix, self.squeeze, self.escape = (bool(normaliser.get(i, 1)) for i in (3, 4, 5))
        if suffix or not self.escape or self.kind not in (UNIGRAM, BPE) or any(t in (USER, UNUSED) for t in self.types):
            raise ValueError("a model of another kind than unigram or merges, or with user-defined or unused pieces")
        self.normalise = Normaliser(self.prefix, self.squeeze, normaliser.get(2, b""))
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        self.unknown = self.types.index(UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.fallback = self.fallback and len(self.byte_ids) == 256
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        score = {p: self.scores[i] for p, i in self.ids.items()}
        # The heaviest arc of a unigram lexicon: a character that no piece covers.
        self.unknown_weight = 10.0 - min(score.values(), default=0.0)
        if self.kind == BPE:
            self.lexicon, self.filter = Lexicon(dict.fromkeys(score, 1.0), 1.0), Filter(score, remembered)
        else:
            self.lexicon, self.filter = Lexicon({p: -w for p, w in score.items()}, self.unknown_weight), None
        self.code = "H" if len(self.pieces) <= 65_536 else "I"
        self.width = array(self.code).itemsize
        self.remembered = remembered
        self.stretches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.plain = [
            (bytes([int(p[3:5], 16)]) if t == BYTE else b" \xe2\x81\x87 " if t == UNKNOWN else b"" if t == CONTROL else p.replace(META, " ").encode())
            for p, t in zip(self.pieces, self.types, strict=True)
        ]

    # --- composition --------------------------------------------------------
    def _lightest_path(self, text: str) -> list[str]:
        """The lightest path through lexicon and filter; of equal ones that with the longest last piece.

        Places are visited in order, so the weight of a place is final when its arcs leave it. Its filter state is the piece before it.
        Sums are of 64 bits. The library adds in 32 bits from the start of the whole text, so that there rounding decides between
        paths of equal weight, such as a+aa and aa+a of a unigram model."""
        n = len(text)
        total, back = array("d", [0.0]) + array("d", [math.inf]) * n, array("q", [0]) * (n + 1)
        leaving, follows = self.lexicon.leaving, self.filter
        for at in range(n):
            here = total[at]
            if here == math.inf:
                continue
            before = text[back[at] : at]
            for end, weight in leaving(text, at):
                w = here + weight
                if w < total[end] and follows is not None:
                    piece = text[at:end]
                    w += follows.weight("", piece)
                    if before and w < math.inf:
                        w += follows.weight(before, piece)
                if w < total[end]:
                    total[end], back[end] = w, at
        out, end = [], n
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]

    # --- encoding -----------------------------------------------------------
    def _solve(self, stretch: str) -> bytes:
        ids: list[int] = []
        for piece in self._lightest_path(stretch):
            i = self.ids.get(piece)
            if i is not None:
                ids.append(i)
            elif self.fallback:
                ids += [self.byte_ids[b] for b in piece.encode()]
            else:
                ids.append(self.unknown)
        return array(self.code, ids).tobytes()

    def _cut(self, text: str) -> bytes:
        """Ids of normalised text, stretch by stretch."""
        out, start, pairs, known = [], 0, self.pairs, self.stretches
        for i in range(1, len(text) + 1):
            if i == len(text) or text[i - 1 : i + 1] not in pairs:
                stretch = text[start:i]
                ids = known.get(stretch)
                if ids is None:
                    ids = self._solve(stretch)
                    if len(stretch) <= LONGEST_REMEMBERED:
                        known[stretch] = ids
                out.append(ids)
                start = i
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self._cut(META + word)
            if len(word) <= LONGEST_REMEMBERED:
                self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as machine-order integers of ``width`` bytes."""
        for held in (self.stretches, self.words):
            if len(held) > self.remembered:
                for p in list(held)[self.remembered // 2 :]:
                    del held[p]
        if self.normalise.table or self.squeeze or not self.prefix or not text or "  " in text or text[0] == " " or text[-1] == " " or META in text:
            got = self._cut(self.normalise(text))
        else:  # a blank begins a word here, and no piece reaches over it
            words = text.split(" ")
            parts = list(map(self.words.get, words))
            if None in parts:
                parts = [self._word(words[i]) if ids is None else ids for i, ids in enumerate(parts)]
            got = b"".join(parts)
        if self.fallback:
            return got
        ids = np.frombuffer(got, f"=u{self.width}")  # a run of unknown characters is one id
        again = ids == self.unknown
        again[1:] &= again[:-1].copy()
        again[:1] = False
        return ids[~again].tobytes()

    def readable(self, text: str) -> str:
        """The normalised text as decoding should give it back."""
        if not self.normalise.table and not self.squeeze and META not in text:
            return text
        text = self.normalise(text).replace(META, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def decode(self, ids: np.ndarray) -> str:
        plain = self.plain
        text = b"".join([plain[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_MACHINES: dict[int, Transducer] = {}


def transducer(model: bytes) -> Transducer:
    """The compiled machines of this Python worker."""
    key = zlib.crc32(model) << 32 | len(model)
    if key not in _MACHINES:
        _MACHINES[key] = Transducer(model)
    return _MACHINES[key]


def encoded(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """``keep`` columns, n_ids, n_byte_ids, ids_crc32 (unsigned 32-bit little-endian ids), round_trip (decoding returns the
    normalised text) and, if asked for, ``ids`` of every row."""

    spark = docs.sparkSession
    ship(spark)
    with open(model, "rb") as f:  # the vocabulary file: of fixed size, sent once to each executor
        sent = spark.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(sent.value)
        byte = np.zeros(len(machine.pieces), bool)
        byte[list(machine.byte_ids.values())] = True
        kind = np.dtype(f"=u{machine.width}")
        for b in batches:
            sizes, bytes_, crcs, trips, lists = [], [], [], [], []
            for text in b.column(len(keep)).to_pylist():
                ids = np.frombuffer(machine.encode(text), kind)
                sizes.append(len(ids))
                bytes_.append(int(byte[ids].sum()))
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                trips.append(machine.decode(ids) == machine.readable(text))
                lists.append(ids)
            made = [pa.array(sizes, pa.int64()), pa.array(bytes_, pa.int64()), pa.array(crcs, pa.int64()), pa.array(trips, pa.bool_())]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype("i4")
                made.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).astype("i4") if lists else np.zeros(0, "i4"))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *made], names=[*keep, *new])

    new = ["n_ids", "n_byte_ids", "ids_crc32", "round_trip", *(["ids"] if with_ids else [])]
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text")
    shape = docs.select(*keep).schema
    for name, kind in zip(new, (T.LongType(), T.LongType(), T.LongType(), T.BooleanType(), T.ArrayType(T.IntegerType())), strict=False):
        shape = shape.add(name, kind)
    return docs.select(*keep, text).mapInArrow(encode, shape)
