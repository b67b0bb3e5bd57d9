"""Token ids in binary segments, each document compressed by itself with one shared zstandard dictionary.

A store is a folder with two Parquet tables, so that any file system Spark knows can hold it:

* ``dictionary``: one row (sha256, data) of the dictionary, trained on serialised id arrays of a bounded sample;
* ``segments``: rows (shard, segment, ahead, first_doc, last_doc, n_docs, n_tokens, blob) in ascending ``doc_id`` order;
  a shard is what one task wrote, ``ahead`` counts the shard's ids before the segment.

A segment's ``blob`` (little endian)::

    b"TIDS" | version u16 | id width u16 | n_docs u32 | dictionary sha256 (32 bytes)
    doc ids i64[n_docs] | known u8[n_docs] | counts u32[n_docs] | offsets u64[n_docs + 1] | frames

``known`` is 0 for a null doc id. Frame i lies between two offsets and is the zstandard frame of document i alone,
so reading a short document costs one small frame. Ids take two bytes if the vocabulary allows, else four.

Defined results: null text is empty and still gets its end id; documents are ordered by doc_id (null first), ties by
a hash of the text, then the text, repeated rows stay; an empty table gives a store without segments; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space of the tokenizer's own pattern. A piece is white space and what follows it up to the next
#: white space; byte-level pre-tokens never cross from one piece into the next.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: White space other than single blanks between words and single line ends between words.
_UNEVEN = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|  | \n|\n | $|\n$")
#: Letters after which a comma or full stop is always a pre-token of its own.
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + "".join(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)))))
#: Pieces whose ids a Python worker remembers. When full, the later half goes: frequent pieces come early.
REMEMBERED = 600_000
#: A segment is closed when its frames reach this many bytes.
SEGMENT_BYTES = 4 << 20
#: Bounds of the dictionary sample: documents, and serialised bytes taken of each.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 8_192, 65_536
#: Most shards whose starts are broadcast (16 bytes each); beyond, they are joined.
BROADCAST_SHARDS = 200_000
_HEAD = struct.Struct("<4sHHI32s")


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library, as little-endian bytes.

    Where the file describes a plain byte-level model, a text is cut into pieces that its pre-tokenizer never joins
    and every distinct piece is encoded once; texts holding an added token, and other models, are encoded whole.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and spec.get("normalizer") is None and not spec.get("truncation") and not spec.get("padding")
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}
        # The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.table = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.remembered = remembered

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, self.dtype).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece; one of a blank and letters is a single pre-token and goes to the merges directly."""
        ids = self.known.get(piece)
        if ids is None:
            letters = piece[1:]
            if piece[0] == " " and letters.isalpha() and max(letters) < "\u0250":
                shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.table)
                ids = self._bytes([t.id for t in self.tokenizer.model.tokenize("\u0120" + shown)])
            elif piece[-1] in ",." and len(piece) > 1 and piece[-2] in _LETTERS:
                ids = self._piece(piece[:-1]) + self._piece(piece[-1])
            elif piece[0] == "\n" and letters.isascii() and letters.isalpha():  # the line end stands alone before a letter
                ids = self._piece("\n") + self._bytes([t.id for t in self.tokenizer.model.tokenize(letters)])
            else:
                ids = self._whole([piece])[0]
            self.known[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a word that stands after a blank. A comma or full stop after a letter is a pre-token of its own, and a
        line end inside starts another piece."""
        if word[-1] in ",." and len(word) > 1 and word[-2] in _LETTERS and "\n" not in word:
            core = word[:-1]
            ids = self.after_blank.get(core)
            if ids is None:
                ids = self.after_blank[core] = self._fresh(core)
            ids += self._piece(word[-1])
        elif "\n" in word:
            ids = b"".join([self._piece(p) for p in _PIECE.findall(" " + word)])
        else:
            ids = self._fresh(word)
        self.after_blank[word] = ids
        return ids

    def _fresh(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._bytes([t.id for t in self.tokenizer.model.tokenize("\u0120" + word)])
        return self._piece(" " + word)

    def _uneven(self, text: str) -> bytes:
        known, one = self.known.get, self._piece
        return b"".join([known(p) or one(p) for p in _PIECE.findall(text)])

    def _room(self) -> None:
        for held in (self.known, self.after_blank):
            if len(held) > self.remembered:
                for p in list(held)[self.remembered // 2 :]:
                    del held[p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """One serialised id array per text, without an end id."""
        return [self._encode(t) for t in texts] if self.by_piece else self._whole(texts)

    def _encode(self, text: str) -> bytes:
        self._room()
        if any(a in text for a in self.added):
            return self._whole([text])[0]
        if not text or text[0] in " \n" or _UNEVEN.search(text) or "\n\n" in text:
            return self._uneven(text)
        words = text.split(" ")
        look, learn = self.after_blank.get, self._word
        got = [self._uneven(words[0]), *map(look, words[1:])]
        at, misses = 0, got.count(None)
        for _ in range(misses):
            at = got.index(None, at)
            w = words[at]
            got[at] = look(w) or learn(w)
        return b"".join(got)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from at most ``SAMPLE_DOCS`` documents (smallest hash of their text), the first ``SAMPLE_BYTES`` of each.

    Only the sample is cut; what is stored is whole. Without enough material the dictionary is empty."""
    import zstandard

    def serial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            yield pd.DataFrame({"ids": [(x + end)[:SAMPLE_BYTES] for x in enc.encode(b["part"].tolist())]})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    drawn = docs.select(text.substr(1, SAMPLE_BYTES).alias("part"), F.xxhash64(text).alias("h")).where(F.length("part") > 0)
    drawn = drawn.orderBy("h", "part").limit(SAMPLE_DOCS).select("part")
    sample = [bytes(r["ids"]) for r in drawn.mapInPandas(serial, "ids binary").collect()]
    size = min(DICTIONARY_BYTES, sum(map(len, sample)) // 10)
    if len(sample) < 8 or size < 1_024:
        return b""
    try:
        return zstandard.train_dictionary(size, sample).as_bytes()
    except zstandard.ZstdError:  # samples too alike or too short to train on
        return b""


def _codec(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def pack(docs: list[tuple[int | None, bytes]], width: int, dictionary: bytes, compressor) -> bytes:
    """One segment of (doc id, serialised ids)."""
    frames = [compressor.compress(ids) for _, ids in docs]
    n = len(docs)
    offsets = np.zeros(n + 1, "<u8")
    np.cumsum([len(f) for f in frames], out=offsets[1:])
    return b"".join([
        _HEAD.pack(b"TIDS", 1, width, n, hashlib.sha256(dictionary).digest()),
        np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes(),
        np.array([d is not None for d, _ in docs], "<u1").tobytes(),
        np.array([len(ids) // width for _, ids in docs], "<u4").tobytes(),
        offsets.tobytes(), *frames,
    ])


class Segment:
    """Read access to one blob; ``ids(i)`` decompresses document i only."""

    def __init__(self, blob: bytes, dictionary: bytes):
        import zstandard

        magic, version, self.width, n, digest = _HEAD.unpack_from(blob)
        if magic != b"TIDS" or version != 1:
            raise ValueError("not a token segment")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("segment was written with another dictionary")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(blob, "<i8", n, at)
        self.known = np.frombuffer(blob, "<u1", n, at + 8 * n)
        self.counts = np.frombuffer(blob, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(blob, "<u8", n + 1, at + 13 * n)
        self.start, self.blob = at + 13 * n + 8 * (n + 1), blob
        self._reader = zstandard.ZstdDecompressor(dict_data=_codec(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        frame = self.blob[self.start + int(self.offsets[i]) : self.start + int(self.offsets[i + 1])]
        got = np.frombuffer(self._reader.decompress(frame), f"<u{self.width}")
        if len(got) != self.counts[i]:
            raise ValueError("a document's frame does not hold its count of ids")
        return got


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, level: int = 3, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Encode ``text`` of every document, append ``end_id`` and write the store to ``path``.

    Documents are dealt by ranges of (doc_id, text hash), so that equal ids on a hot key still spread, and each
    task streams its range into segments: no task holds more than a batch of texts and one segment.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, data binary").write.parquet(f"{path}/dictionary")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Ranges are drawn over ids and a hash, as the sample of range keys goes to the driver.
    doc_first = F.col("doc_id").asc_nulls_first()
    dealt = docs.select("doc_id", text).withColumn("h", F.xxhash64("text")).repartitionByRange(parts, doc_first, "h").sortWithinPartitions(doc_first, "h", "text")

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        enc = encoder(tokenizer)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        compressor = zstandard.ZstdCompressor(level=level, dict_data=_codec(dictionary))
        held: list[tuple[int | None, bytes]] = []
        size = number = ahead = 0

        def closed() -> pd.DataFrame:
            return pd.DataFrame({
                "segment": [number], "ahead": [ahead], "first_doc": pd.array([held[0][0]], "Int64"), "last_doc": pd.array([held[-1][0]], "Int64"), "n_docs": [len(held)],
                "n_tokens": [sum(len(x) for _, x in held) // width], "blob": [pack(held, width, dictionary, compressor)],
            })

        for b in batches:
            for doc, known, ids in zip(b["doc"].tolist(), b["known"].tolist(), enc.encode(b["text"].tolist()), strict=True):
                held.append((doc if known else None, ids + end))
                size += len(ids)
                if size >= segment_bytes:
                    yield closed()
                    ahead += sum(len(x) for _, x in held) // width
                    held, size, number = [], 0, number + 1
        if held:
            yield closed()

    doc = F.col("doc_id").cast("long")
    made = dealt.select(F.coalesce(doc, F.lit(0)).alias("doc"), doc.isNotNull().alias("known"), "text").mapInPandas(
        segments, "segment long, ahead long, first_doc long, last_doc long, n_docs long, n_tokens long, blob binary"
    )
    made.withColumn("shard", F.spark_partition_id()).write.option("parquet.block.size", str(16 << 20)).parquet(f"{path}/segments")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["data"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document of a store.

    A segment knows the ids before it in its shard; the ids before a shard are a prefix sum over one row per shard,
    which the number of writing tasks bounds."""
    dictionary = read_dictionary(spark, path)
    stored = spark.read.parquet(f"{path}/segments")
    shards = stored.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    if shards.count() <= BROADCAST_SHARDS:
        bases = F.broadcast(bases)
    located = stored.select("shard", "ahead", "blob").join(bases, "shard").select((F.col("base") + F.col("ahead")).alias("start"), "blob")

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, blob in zip(b["start"], b["blob"], strict=True):
                seg = Segment(blob, dictionary)
                counts = seg.counts.astype("i8")
                crc = [zlib.crc32(seg.ids(i).astype("<u4").tobytes()) for i in range(len(seg))]
                yield pd.DataFrame({
                    "doc_id": pd.array(seg.doc_ids, "Int64").copy() if seg.known.all() else pd.array([int(d) if k else None for d, k in zip(seg.doc_ids, seg.known)], "Int64"),
                    "start": int(start) + np.cumsum(counts) - counts, "n_tokens": counts, "ids_crc32": crc,
                })

    return located.mapInPandas(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The id arrays stored under one doc id: only segments that can hold it are read, only its frames decompressed."""
    stored = spark.read.parquet(f"{path}/segments").where((F.coalesce("first_doc", F.lit(doc_id)) <= doc_id) & (F.col("last_doc") >= doc_id))
    dictionary = read_dictionary(spark, path)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, number, blob in zip(b["shard"], b["segment"], b["blob"], strict=True):
                seg = Segment(blob, dictionary)
                hits = np.flatnonzero((seg.doc_ids == doc_id) & (seg.known == 1))
                yield pd.DataFrame({"shard": shard, "segment": number, "i": hits, "ids": [seg.ids(i).astype("<u4").tobytes() for i in hits]})

    found = stored.mapInPandas(find, "shard long, segment long, i long, ids binary").orderBy("shard", "segment", "i").collect()
    return [np.frombuffer(bytes(r["ids"]), "<u4") for r in found]
