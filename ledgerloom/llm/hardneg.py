"""Hard negatives for contrastive training: Strassen products of integer tiles and mergeable heaps.

Every anchor is held against all rows, in tiles. A cell is one tile of anchors and a bounded number of tiles of
candidates; it multiplies them by Strassen's recursion on 64-bit integers, tiles padded with zeros where a side is
odd. Additions and products of the recursion are exact modulo 2^64, so a score that fits 63 bits is exact whatever its
intermediate sums do.

Scores of a cell never leave it: a heap keeps, per slot, the first k (score falling, then id rising), and heaps merge, so
a cell sends on at most k rows a slot. The first pass has one slot per anchor (its positives), the second one slot per
anchor and positive (negatives within the window of that positive's score).

Defined results: a row whose id, label or vector is null, or whose vector holds a null or non-finite component, takes no
part; shorter vectors count as filled up with zeros; rows equal in id, label and vector count once; rows that share an
id but differ are candidates of their own, and as an anchor the id asks with the smallest (label, vector); rows with an
anchor's own id are neither its positives nor its negatives; an anchor without positives, and a positive whose window
is empty (as below a negative score), give no rows; fewer than k rows in a slot give fewer; an empty table gives an empty
result. Other columns are not read. Components beyond 2^62 are cut to it; scores must fit 63 bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored
from .shipping import ship
from .topk import whole

#: Rows of a tile of anchors and of candidates, tiles of candidates in a cell; sides up to LEAF are multiplied directly.
ANCHORS, CANDIDATES, CELL, LEAF = 256, 1_024, 8, 32
POSITIVES, NEGATIVES = 5, 5
#: The window: per cent of the positive's score that a negative reaches at least and at most.
AT_LEAST, AT_MOST = 80, 100


def prepared(rows: DataFrame, vec_id: Column, label: Column, vector: Column, scale: int) -> DataFrame:
    """(id, label, v) of the rows that take part: whole-number components, equal rows once."""
    top = 2.0**62
    v = F.transform(whole(vector, scale), lambda x: F.least(F.greatest(x, F.lit(-top)), F.lit(top)).cast("long"))
    made = rows.select(vec_id.cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
    return made.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").dropDuplicates(["id", "label", "v"])


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))))[:m, :n]
    i, j, l = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1, p2 = strassen(a11 + a22, b11 + b22), strassen(a21 + a22, b11)
    p3, p4 = strassen(a11, b12 - b22), strassen(a22, b21 - b11)
    p5, p6, p7 = strassen(a11 + a12, b22), strassen(a21 - a11, b11 + b12), strassen(a12 - a22, b21 + b22)
    out = np.empty((m, n), np.int64)
    out[:i, :l], out[:i, l:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :l], out[i:, l:] = p2 + p4, p1 - p2 + p3 + p6
    return out


class Heaps:
    """The first ``k`` (score, id) of every slot; adding merges."""

    def __init__(self, k: int):
        self.k, self.slot, self.score, self.id = k, *(np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        # Bitwise not falls as the score rises and, unlike the minus, holds for the smallest integer too.
        order = np.lexsort((ids, ~score, slot))
        slot = slot[order]
        first = np.arange(len(slot)) - np.searchsorted(slot, slot) < self.k
        self.slot, self.score, self.id = slot[first], score[order][first], ids[order][first]


def _tiles(rows: DataFrame, size: int, dim: int, dtype: str, extra: dict[str, str]) -> DataFrame:
    """tile (binary columns) of up to ``size`` rows: ids, labels, vectors and the ``extra`` columns as lists."""

    def pack(batches):
        for b in batches:
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                m = np.zeros((len(part), dim), np.int64)
                for i, v in enumerate(part["v"]):
                    m[i, : len(v)] = v
                yield pd.DataFrame({
                    "ids": [part["id"].to_numpy("<i8").tobytes()], "labels": [part["label"].to_numpy("<i8").tobytes()],
                    "vectors": [m.astype(dtype).tobytes()], **{c: [part[c].tolist()] for c in extra},
                })

    schema = "ids binary, labels binary, vectors binary" + "".join(f", {c} array<{t}>" for c, t in extra.items())
    return rows.select("id", "label", "v", *extra).mapInPandas(pack, schema)


def _cells(anchors: DataFrame, candidates: DataFrame, n_groups: int, meet, schema: str) -> DataFrame:
    """``meet(anchor tile, candidate tiles)`` for every tile of anchors and every group of candidate tiles.

    Anchors go to every group and candidates to every tile of anchors, so each cell is one bounded task of its own and no
    side is sent to all executors at once."""
    n_anchors = anchors.count()
    each = candidates.withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_anchors - 1).cast("long")))) if n_anchors else candidates.withColumn("a", F.lit(0).cast("long")).limit(0)
    spread = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))

    def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]
        return meet(x.iloc[0], y) if len(x) and len(y) else pd.DataFrame(columns=columns)

    return spread.groupBy("a", "g").cogroup(each.groupBy("a", "g")).applyInPandas(cell, schema)


def _numbered(tiles: DataFrame, name: str) -> DataFrame:
    """Stored tiles with a dense number ``a``; only their bare keys are ordered together."""
    kept = stored(tiles.withColumn("key", F.monotonically_increasing_id()), name)
    numbers = kept.select("key").withColumn("a", (F.row_number().over(Window.orderBy("key")) - 1).cast("long"))
    return stored(kept.join(numbers, "key").drop("key"), name)


def mined(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
          at_least: int = AT_LEAST, at_most: int = AT_MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: (id, label, v) as :func:`prepared` gives them; ``anchors``: a condition on them. The positives of an anchor
    are its first ``positives`` rows of the same label; the negatives of a positive are the first ``negatives`` rows of another
    label with a score of ``at_least`` to ``at_most`` per cent of the positive's."""
    spark = rows.sparkSession
    ship(spark)
    rows = stored(rows, "vectors")
    seen = rows.agg(
        F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))).alias("top"),
        F.countDistinct(F.when(anchors, F.col("id"))).alias("n"),
    ).first()
    dim, top = max(1, int(seen["dim"] or 0)), int(seen["top"] or 0)
    dtype = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
    asking = rows.where(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    parts = max(1, -(-int(seen["n"] or 0) // ANCHORS))
    tiles = stored(_tiles(rows, CANDIDATES, dim, dtype, {}), "candidate-tiles")
    n_groups = max(1, -(-tiles.count() // CELL))
    key = F.xxhash64("ids", F.lit(1))
    tiles = tiles.withColumn("g", F.pmod(key, F.lit(n_groups)).cast("int"))

    def read(tile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(tile["ids"], "<i8")
        return ids, np.frombuffer(tile["labels"], "<i8"), np.frombuffer(tile["vectors"], dtype).reshape(len(ids), dim).astype(np.int64)

    def first_pass(x, y: pd.DataFrame) -> pd.DataFrame:
        ids, labels, m = read(x)
        heaps = Heaps(positives)
        for _, tile in y.iterrows():
            other, kinds, c = read(tile)
            scores = strassen(m, c.T)
            i, j = np.nonzero((labels[:, None] == kinds[None]) & (ids[:, None] != other[None]))
            heaps.add(i, scores[i, j], other[j])
        return pd.DataFrame({"anchor_id": ids[heaps.slot], "vec_id": heaps.id, "score": heaps.score})

    anchor_tiles = _numbered(_tiles(asking.repartition(parts), 2 * ANCHORS, dim, dtype, {}), "anchor-tiles")
    found = _cells(anchor_tiles, tiles, n_groups, first_pass, "anchor_id long, vec_id long, score long")
    by_anchor = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("place", F.row_number().over(by_anchor)).where(F.col("place") <= positives)
    per_anchor = stored(
        best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("p"))
        .select(F.col("anchor_id").alias("id"), F.col("p.vec_id").alias("pids"), F.col("p.score").alias("pscores")), "positives",
    )

    def second_pass(x, y: pd.DataFrame) -> pd.DataFrame:
        ids, labels, m = read(x)
        pids, pscores = ([[int(i) for i in r] for r in x[c]] for c in ("pids", "pscores"))
        low, high = np.full((len(ids), positives), 1, np.int64), np.zeros((len(ids), positives), np.int64)
        for i, own in enumerate(pscores):
            for j, p in enumerate(own):
                low[i, j], high[i, j] = -(-at_least * p // 100), at_most * p // 100
        heaps = Heaps(negatives)
        for _, tile in y.iterrows():
            other, kinds, c = read(tile)
            scores = strassen(m, c.T)
            strange = (labels[:, None] != kinds[None]) & (ids[:, None] != other[None])
            for j in range(positives):
                i, at = np.nonzero(strange & (scores >= low[:, j, None]) & (scores <= high[:, j, None]))
                heaps.add(i * positives + j, scores[i, at], other[at])
        i, j = heaps.slot // positives, heaps.slot % positives
        return pd.DataFrame({
            "anchor_id": ids[i], "place": j.astype(np.int32), "positive_id": [pids[a][b] for a, b in zip(i, j, strict=True)],
            "positive_score": [pscores[a][b] for a, b in zip(i, j, strict=True)], "negative_id": heaps.id, "negative_score": heaps.score,
        })

    with_positives = _tiles(asking.join(per_anchor, "id").repartition(parts), 2 * ANCHORS, dim, dtype, {"pids": "array<long>", "pscores": "array<long>"})
    hard = _cells(
        _numbered(with_positives, "anchor-tiles"), tiles, n_groups, second_pass,
        "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    by_positive = Window.partitionBy("anchor_id", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    return hard.withColumn("rank", F.row_number().over(by_positive).cast("int")).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
