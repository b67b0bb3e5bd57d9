"""Quality scores of documents: random Fourier features of document statistics, ridge, isotonic calibration.

Every text becomes ``len(STATISTICS)`` numbers, read off its bytes. Standardised, they go through ``FEATURES`` random cosines whose
inner products approximate a Gaussian kernel. Labelled rows give partition sums of the normal equations, which add up
to one system of fixed size; its ridge solution scores rows. Scores of labelled rows that took no part in the fit are
counted in bins, and pooling adjacent violators over the bins makes the calibration curve.

Labels are learned from rows with ``crc32(doc_id as text) mod 5 <> 0`` only: remainder 1 calibrates, 2 to 4 fit. At
most about ``MAX_LABELLED`` labelled rows are used (a hash of the id decides; a bound on the fit, not on what is scored).
Labels, language, source and id are never inputs of a score.

Defined results: null text counts as empty and gets a score like any other; a row without id is scored and not held
out; several labels of an id vote by their mean; null labels are left out; without usable labels of both kinds every score
is the mean label, 0.5 if there is none; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

FOLDS = 5
FEATURES, RIDGE, WIDTH = 256, 1e-3, 1.0
MAX_LABELLED = 200_000
FIT_PARTITIONS, BINS = 32, 1_000
STATISTICS = (
    "chars", "words", "lines", "word_length", "line_length", "distinct_words", "repeats_before", "distinct_lines", "symbols", "bars", "marks",
    "digits", "capitals", "stops", "high_bytes", "blanks", "longest_word", "entropy", "ended_lines", "brackets",
)
_SYMBOLS, _BARS, _MARKS, _DIGITS = b"#*$%&<>@^~=_\\", b"|", b"!?", b"0123456789"
_CAPITALS, _STOPS, _BLANKS, _BRACKETS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:", b" \t\n\x0b\f\r", b"()[]{}\"'"
_HIGH = bytes(range(128, 256))


def statistics(text: bytes) -> list[float]:
    """The statistics of one text in UTF-8."""
    n = len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    words, lines = text.split(), text.split(b"\n")
    n_words = max(1, len(words))

    def share(of: bytes) -> float:
        return (n - len(text.translate(None, of))) / n

    p = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    p = p[p > 0]
    full = [x for x in lines if x]
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), n / n_words, np.log1p(n / len(lines)), len(set(words)) / n_words,
        sum(map(eq, words, words[1:])) / n_words, len(set(full)) / max(1, len(full)), share(_SYMBOLS), share(_BARS), share(_MARKS),
        share(_DIGITS), share(_CAPITALS), share(_STOPS), share(_HIGH), share(_BLANKS), np.log1p(max(map(len, words), default=0)),
        float(-(p * np.log(p)).sum()), sum(x[-1:] in b".!?:;" for x in full) / max(1, len(full)), share(_BRACKETS),
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, stats (float32 values of ``STATISTICS``) of every row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            got = [np.array(statistics(t.as_py()), "<f4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(
        describe, "doc_id long, stats binary"
    )


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f4").reshape(len(column), len(STATISTICS)).astype(float)


class Model:
    """What scoring needs; of fixed size, so it travels in the task closure."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = len(STATISTICS)
        self.mean, self.scale = mean, scale
        self.waves = rng.normal(size=(d, FEATURES)) / (WIDTH * np.sqrt(d))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.at, self.curve = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ self.waves + self.phase), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, 0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated score; a thousandth of the uncalibrated one keeps the order where the curve is flat."""
        raw = self.raw(stats)
        return 0.999 * np.interp(raw, self.at, self.curve) + 0.001 * raw


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Least-squares non-decreasing fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(stats: DataFrame, labels: DataFrame, target: str = "quality", most: int = MAX_LABELLED) -> Model:
    """Learn ``target`` from (doc_id, stats) and labels (doc_id, target)."""
    votes = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    )
    votes = stored(votes, "votes")
    n = votes.count()
    if n > most:
        votes = votes.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * most / n))
    known = stored(
        stats.where(fold(F.col("doc_id")) != 0).join(votes, "doc_id").select(fold(F.col("doc_id")).alias("part"), "stats", "y"), "labelled",
    )

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, square, ones, rows = np.zeros(len(STATISTICS)), np.zeros(len(STATISTICS)), 0.0, 0
        for b in batches:
            if len(b):
                x = _matrix(b["stats"])
                total, square, ones, rows = total + x.sum(0), square + (x**2).sum(0), ones + b["y"].sum(), rows + len(b)
        yield pd.DataFrame({"total": [total.tobytes()], "square": [square.tobytes()], "ones": [ones], "n": [rows]})

    few = known.coalesce(FIT_PARTITIONS)
    parts = few.mapInPandas(moments, "total binary, square binary, ones double, n long").collect()
    rows, ones = sum(p["n"] for p in parts), sum(p["ones"] for p in parts)
    if not rows or ones in (0, rows):
        model = Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
        model.curve = np.full(2, ones / rows if rows else 0.5)
        return model
    mean = sum(np.frombuffer(p["total"]) for p in parts) / rows
    spread = np.sqrt(np.maximum(sum(np.frombuffer(p["square"]) for p in parts) / rows - mean**2, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, right = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for b in batches:
            b = b[b["part"] != 1]
            if len(b):
                z = model.features(_matrix(b["stats"]))
                gram, right = gram + z.T @ z, right + z.T @ b["y"].to_numpy()
        yield pd.DataFrame({"gram": [gram.tobytes()], "right": [right.tobytes()]})

    parts = few.mapInPandas(sums, "gram binary, right binary").collect()
    gram = sum(np.frombuffer(p["gram"]) for p in parts).reshape(FEATURES + 1, FEATURES + 1)
    ridge = RIDGE * max(1.0, gram[-1, -1]) * np.eye(FEATURES + 1) / FEATURES
    model.weights = np.linalg.solve(gram + ridge, sum(np.frombuffer(p["right"]) for p in parts))

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["part"] == 1]
            if len(b):
                yield pd.DataFrame({"bin": np.round(model.raw(_matrix(b["stats"])) * BINS).astype(int), "y": b["y"].to_numpy()})

    bins = few.mapInPandas(binned, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()
    if bins:
        model.at = np.array([r["bin"] / BINS for r in bins])
        model.curve = isotonic(np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins], float))
    else:  # nothing to calibrate with: the ridge score itself
        model.curve = np.array([0.0, 1.0])
    return model


def scored(stats: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b[["doc_id", "known", "held_out"]].assign(score=model.score(_matrix(b["stats"])))

    known = F.col("doc_id").isNotNull()
    # pandas has no null in whole numbers, so a flag says which ids are known.
    rows = stats.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), known.alias("known"), (known & (fold(F.col("doc_id")) == 0)).alias("held_out"), "stats")
    return rows.mapInPandas(score, "doc_id long, known boolean, held_out boolean, score double").select(
        F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
