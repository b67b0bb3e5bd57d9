"""Exact top-k inner products through a pivot-distance index.

Vectors become whole numbers first (``floor(scale * x)``). With M the largest norm, a vector x is placed at
(x, sqrt(M^2 - |x|^2)) and a query q at (q, 0): then d^2 = |q|^2 + M^2 - 2 q.x, so a larger score is a smaller
distance. The index keys every vector by its nearest pivot and its distance to it, sorted; an annulus is a bounded run of
that order, [low, high] around its pivot, and a cell a bounded run of annuli. Queries are sorted in with the vectors, so
a query first meets the annuli around its own distance, which gives a k-th score; then it visits only annuli whose
triangle-inequality bound can still reach that score.

Pivots are a bounded sample (``PIVOTS`` rows of smallest hash); every row is indexed and results are exact whatever
the pivots. Cells and blocks of queries are stored and read where they meet: neither side is shuffled for the other, a
task holds a bounded number of both, and what leaves it are the k best of a query.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part; shorter vectors count
as filled up with zeros; rows with a query's own id are never its candidates; rows repeated with equal id and vector
count once; two vectors under one id are two candidates, but as a query the id asks with its smallest vector; a null id takes no part; fewer than k candidates give fewer
rows; ties go to the smaller id; an empty table gives an empty result. Scores are exact while they fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored

#: Pivots of the index, rows of an annulus, queries of a block.
PIVOTS, BLOCK, QUERIES = 64, 1_024, 8_192
#: Bytes of a cell's vectors, or of a block's, rows of a cell at most; blocks of queries that a task holds; bytes of a range of the sorted rows.
CELL_BYTES, CELL, HELD, RANGE_BYTES = 1 << 20, 8_192, 12, 32 << 20
#: Cells of a part that blocks of queries meet as one, tasks for which parts are made smaller.
PART_CELLS, TASKS = 64, 128
#: No k-th score yet.
NONE = np.iinfo(np.int64).min


def whole(vector: Column, scale: int) -> Column:
    """Whole-number components as doubles; null where the vector takes no part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(v, lambda x: F.floor(x * scale).cast("double")))


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    lists = column.tolist()
    if lists and all(len(v) == dim for v in lists):
        return np.concatenate(lists).reshape(len(lists), dim).astype(float)
    out = np.zeros((len(lists), dim))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _dtype(top: float) -> str:
    """The smallest type that holds every component of vectors whose squared norm is at most ``top``."""
    return "<i2" if top < 2.0**30 else "<i4" if top < 2.0**62 else "<f8"


def _exact(top: float) -> type:
    """The fastest type with exact products of vectors whose squared norms are at most ``top``, as no partial sum is beyond it."""
    return np.float32 if top < 2.0**24 else np.float64 if top < 2.0**53 else np.int64


def _norms(m: np.ndarray) -> np.ndarray:
    return (m.astype(float) ** 2).sum(1)


def _scores(queries: np.ndarray, vectors: np.ndarray, top: float) -> np.ndarray:
    """Exact integer scores of vectors whose squared norms are at most ``top``."""
    kind = _exact(top)
    return queries.astype(kind, copy=False) @ vectors.astype(kind, copy=False).T


def _distances(points: np.ndarray, lifts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of lifted points to lifted pivots (the last column is the lift)."""
    full = np.hstack([points, lifts[:, None]])
    d = (full**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(d, 0))


def _best(queries: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of every row by score, ties by id, a query's own id left out."""
    rows, columns = np.nonzero(ids[None] != queries[:, None])
    if scores.shape[1] > k + 1:  # all that reach the (k + 1)-th best; at most one of these is the query's own
        floor = np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, scores.shape[1] - k - 1]
        own = (ids[None] == queries[:, None]).sum(1)
        floor[own > 1] = np.iinfo(np.int64).min  # ids that repeat: look at all
        rows, columns = np.nonzero((scores >= floor[:, None]) & (ids[None] != queries[:, None]))
    order = np.lexsort((ids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], columns[place < k]


class Index:
    """Stored cells of annuli, stored blocks of queries with a first k-th score, and what a search needs to know of the whole."""

    def __init__(self, cells: DataFrame, asking: DataFrame, dim: int, top: float, pivots: np.ndarray):
        self.cells, self.asking, self.dim, self.top, self.pivots, self.dtype = cells, asking, dim, top, pivots, _dtype(top)


#: What is known of an annulus: the row of its cell behind its last, its pivot and distances from it, its smallest id.
RIM = np.dtype([("end", "<i4"), ("pivot", "<i4"), ("low", "<f8"), ("high", "<f8"), ("least_id", "<i8")])


def _rims(pivot: np.ndarray, far: np.ndarray, ids: np.ndarray, block: int) -> np.ndarray:
    """Annuli of a cell: runs of one pivot, cut after ``block`` rows."""
    at = np.arange(len(ids))
    run = np.maximum.accumulate(np.where(np.diff(pivot, prepend=-1) != 0, at, 0))
    starts = np.flatnonzero((at - run) % block == 0)
    out = np.empty(len(starts), RIM)
    out["end"], out["pivot"], out["low"] = np.append(starts[1:], len(ids)), pivot[starts], far[starts]
    out["high"], out["least_id"] = far[out["end"] - 1], np.minimum.reduceat(ids, starts)
    return out


def build(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERIES) -> Index:
    """Index (id, v) rows, and queries sorted in with them; ``v`` holds whole numbers as doubles."""
    spark = vectors.sparkSession
    queries = stored(queries.select("id", "v"), "asking")
    both = vectors.select("id", "v", F.lit(False).alias("asks")).unionByName(queries.withColumn("asks", F.lit(True)))
    size = both.agg(
        F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top"),
        F.count("*").alias("n"), F.count_if("asks").alias("asking"),
    ).first()
    dim, top = int(size["dim"] or 0), float(size["top"] or 0.0)
    hashed = vectors.select(F.xxhash64("v").alias("h"), "v")
    least = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(pivots).collect()]  # first the hashes alone: vectors don't move
    drawn = hashed.where(F.col("h").isin(least)).distinct().orderBy("h").limit(pivots).collect() if least else []
    points = _matrix(pd.Series([r["v"] for r in drawn]), dim) if drawn else np.zeros((0, dim))
    lifted = np.hstack([points, np.sqrt(np.maximum(top - (points**2).sum(1), 0))[:, None]])
    dtype = _dtype(top)
    wide = max(1, dim * np.dtype(dtype).itemsize)
    cell = max(1, min(CELL, CELL_BYTES // wide))
    query_block = max(1, min(query_block, CELL_BYTES // wide))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m, asks = _matrix(b["v"], dim), b["asks"].to_numpy(bool)
            near, far = np.zeros(len(m), int), np.zeros(len(m))
            if len(lifted):
                d = _distances(m, np.where(asks, 0, np.sqrt(np.maximum(top - (m**2).sum(1), 0))), lifted)
                near = d.argmin(1)
                far = d[np.arange(len(d)), near]
            yield pd.DataFrame({"pivot": near, "far": far, "asks": asks, "id": b["id"], "v": [r.tobytes() for r in m.astype(dtype)]})

    keyed = both.mapInPandas(place, "pivot int, far double, asks boolean, id long, v binary")
    # Ranges of (pivot, distance, id): a group of equal vectors is cut by id, so no range depends on one value.
    # As many as the setting says while they fill cells, and more where a range would be large.
    parts = max(1, -(-size["n"] * (wide + 40) // RANGE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // cell)))
    dealt = keyed.repartitionByRange(parts, "pivot", "far", "id").sortWithinPartitions("pivot", "far", "id", "asks")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, near = [], None

        def closed(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """The cell of a run of rows, and its queries with the k-th score and id of what they find in it or else in the one before."""
            nonlocal near
            asks = part["asks"].to_numpy(bool)
            own, asked = part[~asks], part[asks]
            if len(own):
                ids, packed = own["id"].to_numpy("<i8"), b"".join(own["v"])
                near = ids, np.frombuffer(packed, dtype).reshape(len(ids), dim)
                rims = _rims(own["pivot"].to_numpy(), own["far"].to_numpy(), ids, block)
                yield pd.DataFrame({"qids": [None], "qvectors": [None], "kth": [None], "last": [None], "ids": [ids.tobytes()], "vectors": [packed], "rims": [rims.tobytes()]})
            for at in range(0, len(asked), 512):
                some = asked.iloc[at : at + 512]
                qids, packed = some["id"].to_numpy("<i8"), b"".join(some["v"])
                kth, last = np.full(len(some), NONE), np.full(len(some), np.iinfo(np.int64).max)
                if near is not None:
                    ids, m = near
                    scores = _scores(np.frombuffer(packed, dtype).reshape(len(qids), dim), m, top)
                    mine, found = _best(qids, ids, scores, k)
                    n = np.bincount(mine, minlength=len(qids))
                    full, end = n == k, np.cumsum(n) - 1
                    kth[full] = scores[mine[end[full]], found[end[full]]].astype(np.int64)
                    last[full] = ids[found[end[full]]]
                yield pd.DataFrame({"qids": [qids.tobytes()], "qvectors": [packed], "kth": [kth.tobytes()], "last": [last.tobytes()], "ids": [None], "vectors": [None], "rims": [None]})

        for b in batches:
            rest.append(b)
            if sum(map(len, rest)) >= cell:
                rows = pd.concat(rest, ignore_index=True)
                whole_cells = len(rows) // cell * cell
                for at in range(0, whole_cells, cell):
                    yield from closed(rows.iloc[at : at + cell])
                rest = [rows.iloc[whole_cells:]]
        if any(map(len, rest)):
            yield from closed(pd.concat(rest, ignore_index=True))

    made = stored(dealt.mapInPandas(cut, "qids binary, qvectors binary, kth binary, last binary, ids binary, vectors binary, rims binary"), "annuli")
    columns = ["qids", "qvectors", "kth", "last"]

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of up to ``query_block`` queries of the small groups beside each other."""
        rows, n = [], 0
        for b in batches:
            for row in b[columns].itertuples(index=False):
                if rows and n + len(row.qids) // 8 > query_block:
                    yield pd.DataFrame([[b"".join(x) for x in zip(*rows, strict=True)]], columns=columns)
                    rows, n = [], 0
                rows.append(row)
                n += len(row.qids) // 8
        if rows:
            yield pd.DataFrame([[b"".join(x) for x in zip(*rows, strict=True)]], columns=columns)

    blocks = made.where("qids IS NOT NULL").select(*columns).coalesce(max(1, -(-size["asking"] // query_block)))
    blocks = blocks.mapInPandas(group, "qids binary, qvectors binary, kth binary, last binary")
    asking = stored(blocks.withColumn("qblock", F.monotonically_increasing_id()), "query-blocks")
    # A query gets k rows from each part of the cells: as few parts as hold a bounded number of cells and keep many tasks busy.
    n_cells, n_blocks = -(-size["n"] // cell), -(-size["asking"] // query_block)
    cells = made.where("ids IS NOT NULL").select("ids", "vectors", "rims").coalesce(max(1, -(-n_cells // PART_CELLS), min(n_cells, TASKS // max(1, n_blocks))))
    cells = cells.withColumn("cell", F.monotonically_increasing_id())
    return Index(cells, asking, dim, top, lifted)


class Asking:
    """A block of queries: what is left to look for, and the k best so far of the cells that it has met."""

    def __init__(self, ids: bytes, vectors: bytes, kth: bytes, last: bytes, index: tuple, k: int):
        dim, self.top, pivots, dtype = index
        self.k, self.ids = k, np.frombuffer(ids, "<i8")
        self.v = np.frombuffer(vectors, dtype).reshape(len(self.ids), dim)
        self.norm = _norms(self.v)
        self.far = _distances(self.v.astype(float), np.zeros(len(self.v)), pivots)
        self.kth, self.last = np.frombuffer(kth, "<i8").copy(), np.frombuffer(last, "<i8").copy()
        self.found, self.more, self.n_more = tuple(np.zeros(0, np.int64) for _ in range(3)), [], 0

    def meet(self, ids: np.ndarray, vectors: np.ndarray, norm: float, rims: np.ndarray) -> None:
        """Visit the annuli of a cell whose bound still reaches a query's k-th score."""
        most = max(self.norm.max(), norm)
        kind = _exact(most)
        self.v, vectors = self.v.astype(kind, copy=False), vectors.astype(kind, copy=False)
        start = 0
        for end, pivot, low, high, least_id in rims.tolist():
            far = self.far[:, pivot]
            gap = np.maximum(np.maximum(low - far, far - high), 0)
            # An equal score counts only with a smaller id than that of the k-th; the first k-th itself is still to be found.
            least = self.kth + (self.last < least_id)
            wanted = np.flatnonzero((self.norm + self.top - gap**2) / 2 + 1e-6 * (self.norm + self.top + 1) >= least)
            for at in range(0, len(wanted), 512):
                some = wanted[at : at + 512]
                scores = (self.v[at : at + 512] if len(wanted) == len(self.v) else self.v[some]) @ vectors[start:end].T
                least_here = least[some].astype(kind)
                reach = np.flatnonzero(scores.max(1) >= least_here)
                if len(reach):
                    some, scores = some[reach], scores[reach]
                    i, j = np.divmod(np.flatnonzero(scores >= least_here[reach, None]), end - start)
                    slot, other = some[i], ids[start + j]
                    strange = other != self.ids[slot]
                    self.more.append((slot[strange], scores[i, j].astype(np.int64)[strange], other[strange]))
                    self.n_more += len(slot)
            start = end
            if self.n_more > len(self.ids):
                self.settle()

    def settle(self) -> None:
        """Keep the k best of each query and raise its k-th score."""
        if not self.n_more:
            return
        slot, score, ids = (np.concatenate(x) for x in zip(self.found, *self.more, strict=True))
        order = np.lexsort((ids, ~score, slot))
        slot = slot[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = place < self.k
        self.found = slot[kept], score[order][kept], ids[order][kept]
        full = order[place == self.k - 1]
        at = slot[place == self.k - 1]
        # What the first look found is as good as what is found now, until this has k of its own.
        better = (score[full] > self.kth[at]) | ((score[full] == self.kth[at]) & (ids[full] < self.last[at]))
        self.kth[at[better]], self.last[at[better]] = score[full[better]], ids[full[better]]
        self.more, self.n_more = [], 0


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a query meets at most k rows per annulus."""
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` for every row of ``queries`` (both id, v)."""
    index = build(vectors, queries, k, pivots, block, query_block)
    dim, dtype, known = index.dim, index.dtype, (index.dim, index.top, index.pivots, index.dtype)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Asking] = {}
        cell, its = None, None

        def told() -> Iterator[pa.RecordBatch]:
            for x in held.values():
                x.settle()
                slot, score, ids = x.found
                yield pa.RecordBatch.from_arrays([x.ids[slot], ids, score], ["query_id", "vec_id", "score"])
            held.clear()

        for b in batches:
            for i in range(b.num_rows):  # in Arrow's own memory: a batch of large rows is not copied as a whole
                row = {c: b.column(c)[i] for c in b.schema.names}
                if row["cell"].as_py() != cell:
                    ids = np.frombuffer(row["ids"].as_buffer(), "<i8").copy()
                    m = np.frombuffer(row["vectors"].as_buffer(), dtype).reshape(len(ids), dim).copy()
                    cell, its = row["cell"].as_py(), (ids, m, _norms(m).max(), np.frombuffer(row["rims"].as_py(), RIM))
                block_at = row["qblock"].as_py()
                if block_at not in held:
                    if len(held) >= HELD:
                        yield from told()
                    held[block_at] = Asking(*(row[c].as_py() for c in ("qids", "qvectors", "kth", "last")), known, k)
                held[block_at].meet(*its)
        yield from told()

    # Every block of queries meets every cell, in rows of a megabyte or two: what is stored is read again rather than moved.
    pairs = index.asking.crossJoin(index.cells).select("cell", "ids", "vectors", "rims", "qblock", "qids", "qvectors", "kth", "last")
    found = pairs.mapInArrow(meet, "query_id long, vec_id long, score long")
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def prepared(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, v) of the rows that take part, equal rows once."""
    return rows.select(F.col(vec_id).cast("long").alias("id"), whole(F.col(vector), scale).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).dropDuplicates(["id", "v"])
