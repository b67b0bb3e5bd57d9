"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct word shingles (``SHINGLE`` words, ASCII letters in lower case) as 64-bit hashes. Its
sketch has ``REGISTERS`` registers: the register is the truncated, exponentially spaced level
``floor(1 - log_b(x))`` of the least of exponentially distributed values x of the set's elements. Registers of two
sets merge by maximum, and two registers agree with a probability close to the Jaccard similarity.

1. Documents with equal sets are one class; only class representatives go on.
2. Band values of ``BAND_ROWS`` registers group candidates. In every group one member, drawn by a hash of the
   band, is the centre that the others are paired with: a group of n gives n - 1 pairs.
3. The similarity of a pair is estimated by maximum likelihood from its registers and the known set sizes; pairs
   far below the threshold go. For every document the best pair is confirmed on the full sets first, then the pairs
   that would still join two components. Members of groups that are still in several components, which a centre need
   not resemble as they may resemble each other, are compared across components in blocks of bounded size; blocks of one component never meet. So no
   link between components is skipped within a group, and pairs of a group are never rows.

At similarity 0.8 two documents share none of the 32 groups with probability 4e-6 (0.672^32).

Defined results: null and empty texts, and texts without words, have empty sets and no links; rows without doc_id take
no part, have no component and are kept; rows that share a doc_id are one document to :func:`groups`, in one component with
whatever any of their texts links to, and documents of their own to :func:`deduplicated`; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .components import components
from .shipping import ship

SHINGLE, REGISTERS, BAND_ROWS = 4, 160, 5
#: Parameters of the sketch: base, rate, highest level.
BASE, RATE, LEVELS = 1.001, 20.0, 65_535
#: A pair is confirmed on its full sets when its estimate is at most this much below the threshold (over 5 standard errors).
MARGIN = 0.18
#: Members of a block of a group whose members are compared.
MEMBERS = 128
#: Bytes of text worked on at once.
CHUNK = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20_240_229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_MULT = _rng.integers(1, 2**63, 1 << 10, dtype=_U) * _U(2) + _U(1)
_ADD = _rng.integers(0, 2**63, 1 << 10, dtype=_U)
_BASE_P = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE_P, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, CHUNK + CHUNK // 4)
        _POWERS.clear()
        for p in (_BASE_P, _BASE_INV):
            steps = np.full(n, p, _U)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads all bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of the texts data[offsets[i]:offsets[i + 1]] (UTF-8 bytes)."""
    n_docs, base = len(offsets) - 1, int(offsets[0])
    offsets = offsets - base
    data = _LOWER[data[base : base + int(offsets[-1])]]
    none = np.zeros(0, _U)
    if not len(data):
        return [none] * n_docs
    blank = _BLANK[data]
    first = np.ones(len(data) + 1, bool)  # a blank or a text's start stands before
    first[1:] = blank
    first[offsets] = True
    last = np.ones(len(data), bool)
    last[:-1] = blank[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(first[:-1] & ~blank), np.flatnonzero(last & ~blank) + 1
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))
        edges = np.searchsorted(starts, offsets)
        if len(words) >= k:
            grams = np.zeros(len(words) - k + 1, _U)
            for j in range(k):
                grams += words[j : len(words) - k + 1 + j] * _MULT[j]
            grams = mix(grams)
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(grams[a : b - k + 1]))
            elif b > a:
                short = (words[a:b] * _MULT[100 : 100 + b - a]).sum(dtype=_U) + _ADD[b - a]
                out.append(mix(np.array([short], _U)))
            else:
                out.append(none)
    return out


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """One row of m levels per set; sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((m, len(sets)), _U)
    work = np.empty_like(flat)
    with np.errstate(over="ignore"):
        for j in range(m):
            np.multiply(flat, _MULT[200 + j], out=work)
            np.add(work, _ADD[200 + j], out=work)
            least[j] = np.minimum.reduceat(work, starts)
    x = -np.log1p(-(least.T.astype(float) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LEVELS).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of a union."""
    return np.maximum(a, b)


def bands(regs: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit value per band and set."""
    n = regs.shape[1] // rows
    cut = regs[:, : n * rows].reshape(len(regs), n, rows).astype(_U)
    with np.errstate(over="ignore"):
        return mix((cut * _MULT[500 : 500 + rows]).sum(2, dtype=_U) + _ADD[:n][None]).view(np.int64)


def likelihood(plus: np.ndarray, minus: np.ndarray, same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity that makes the counts of registers above, below and equal most likely, given the set sizes."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 129)[None] * top  # a grid is enough: the margin is far wider

    def above(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    p, q = above(u - v * grid), above(v - u * grid)
    value = plus[:, None] * np.log(p) + minus[:, None] * np.log(q) + same[:, None] * np.log(np.clip(1 - p - q, 1e-12, 1))
    return np.take_along_axis(grid, value.argmax(1)[:, None], 1)[:, 0]


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of rows with about ``CHUNK`` bytes each, without copying the texts."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    n = len(column)
    if not n:
        return
    _, where, content = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, min(to, n), data, offsets[at : min(to, n) + 1]
        at = to


_SKETCH = "doc_id long, n long, k1 long, k2 long, regs binary, bands array<long>"


def sketches(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n (set size), k1, k2 (digest of the set), regs, bands of every row; nulls for empty sets."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in _chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, k)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                regs_, bands_, keys = [None] * len(sets), [None] * len(sets), np.zeros((len(sets), 2), np.int64)
                if len(full):
                    got = registers([sets[i] for i in full])
                    values = bands(got)
                    for r, i in enumerate(full):
                        regs_[i], bands_[i] = got[r].astype("<u2").tobytes(), values[r]
                        keys[i] = np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                    pa.array(regs_, pa.binary()), pa.array(bands_, pa.list_(pa.int64())),
                ], names=["doc_id", "n", "k1", "k2", "regs", "bands"])

    return _texts(docs).mapInArrow(sketch, _SKETCH)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the documents in ``nodes``: the full sets as 64-bit hashes."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in _chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([s.view(np.int64) for s in shingle_sets(data, offsets, k)], pa.list_(pa.int64())),
                ], names=["node", "shingles"])

    chosen = _texts(docs).join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return chosen.mapInArrow(full, "node long, shingles array<long>")


def _estimated(pairs: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) whose likelihood estimate is at least ``floor``, with it."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("regs_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("regs_b"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x, y = (np.frombuffer(b"".join(b[c]), "<u2").reshape(len(b), -1) for c in ("regs_a", "regs_b"))
                plus, minus = (x > y).sum(1), (x < y).sum(1)
                j = likelihood(plus, minus, x.shape[1] - plus - minus, b["n_a"].to_numpy(float), b["n_b"].to_numpy(float))
                keep = j >= floor
                yield pd.DataFrame({"a": b["a"][keep], "b": b["b"][keep], "estimate": j[keep]})

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInPandas(score, "a long, b long, estimate double")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on the full sets."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for p, q in zip(b["x"], b["y"], strict=True):
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.loc[np.array(ok, bool), ["a", "b"]]

    return (
        pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .mapInPandas(check, "a long, b long")
    )


def _blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How the members (value, node, component) of open groups are cut, as two stored tables.

    parts: (value, component, own, n_blocks). A component with ``MEMBERS`` members or more has blocks of its own, the smaller ones
    of a group share blocks. meetings: (value, block, lo, hi): the pairs of blocks that a block takes part in. Blocks of one component
    never meet, so one stranger in a large component costs one pass over it, however large it is."""
    size = members.groupBy("value", "component").agg(F.count("*").alias("size"))
    size = stored(size, "open-components").withColumn("own", F.col("size") >= MEMBERS)
    shared = size.where("NOT own").groupBy("value").agg(F.sum("size").alias("size")).withColumn("own", F.lit(False))
    count = F.greatest(F.lit(1), F.round(F.col("size") / MEMBERS)).cast("int").alias("n_blocks")
    shared = shared.select("value", "own", count)
    large = size.where("own").select("value", "component", "own", count)
    parts = stored(size.where("NOT own").select("value", "component", "own").join(shared, ["value", "own"]).select("value", "component", "own", "n_blocks").unionByName(large), "open-parts")
    cut = large.select("value", "own", "component", "n_blocks").unionByName(shared.select("value", "own", F.lit(None).cast("long").alias("component"), "n_blocks"))
    blocks = stored(cut.select("value", "own", "component", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("no"))
                    .select("value", F.struct("own", F.coalesce("component", F.lit(0).cast("long")).alias("component"), "no").alias("block")), "open-blocks")
    pairs = blocks.withColumnRenamed("block", "lo").join(blocks.withColumnRenamed("block", "hi"), "value")
    pairs = pairs.where((F.col("lo") <= F.col("hi")) & ~(F.col("lo.own") & F.col("hi.own") & (F.col("lo.component") == F.col("hi.component"))))
    meetings = pairs.select("value", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("block"))
    return parts, stored(meetings, "open-meetings")


def _within_open(open_members: DataFrame, percent: int, floor: float, payload: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Links (a, b) between different components inside open groups, confirmed on the full sets.

    ``open_members``: value, band, node, n, component; ``payload``: stored tables of regs and bands, and of shingles, by node, by default
    columns of ``open_members``. A group is cut into blocks of about ``MEMBERS`` and two blocks at a time meet in one row, so tasks stay
    bounded and pairs are never rows. A pair that shares several bands is looked at under the first of them only. Blocks are given
    out to the short rows and first meet with their registers alone; the members that have a likely partner there, few as a rule,
    meet again with their full sets."""
    members = open_members.select("value", "band", "node", "n", "component")
    parts, meetings = _blocks(members)
    number = F.pmod(F.when(F.col("own"), F.xxhash64("node")).otherwise(F.xxhash64("component")), F.col("n_blocks")).cast("int")
    owner = F.when(F.col("own"), F.col("component")).otherwise(F.lit(0).cast("long"))
    placed = members.join(parts, ["value", "component"]).withColumn("block", F.struct("own", owner.alias("component"), number.alias("no")))
    spread = placed.join(meetings, ["value", "block"]).select("value", "band", "node", "n", "component", "lo", "hi", (F.col("block") != F.col("lo")).cast("int").alias("side"))
    regs_of, sets_of = payload or [open_members.select("node", *c).dropDuplicates(["node"]) for c in (("regs", "bands"), ("shingles",))]
    spread = stored(spread, "open-spread").join(regs_of, "node")
    place, columns = ("value", "band", "lo", "hi"), ("node", "n", "component", "side", "regs", "bands")

    def met(rows: DataFrame, *more: str) -> DataFrame:
        lists = [F.collect_list(c).alias(c) for c in (*columns, *more)]
        return rows.groupBy(*place).agg(*lists).withColumn("apart", F.col("lo") != F.col("hi"))

    def likely(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, x, y) of meetings with likely pairs; x and y are places in the flattened lists."""
        col = {name: batch.column(name) for name in batch.schema.names}
        at = np.concatenate([[0], np.cumsum(col["node"].value_lengths().to_numpy())])
        n, component, side = (col[c].flatten().to_numpy() for c in columns[1:4])
        regs = np.frombuffer(b"".join(col["regs"].flatten().to_pylist()), "<u2").reshape(len(n), -1)
        bands_ = col["bands"].flatten().flatten().to_numpy().reshape(len(n), -1)
        for row, (band, apart) in enumerate(zip(col["band"].to_pylist(), col["apart"].to_pylist(), strict=True)):
            start, stop = at[row], at[row + 1]
            if (component[start:stop] == component[start]).all():
                continue
            x, y = (i + start for i in np.triu_indices(stop - start, 1))
            keep = (component[x] != component[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            if apart:
                keep &= side[x] != side[y]
            x, y = x[keep], y[keep]
            keep = (bands_[x] == bands_[y]).argmax(1) == band
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            plus, minus = (regs[x] > regs[y]).sum(1), (regs[x] < regs[y]).sum(1)
            keep = likelihood(plus, minus, regs.shape[1] - plus - minus, n[x].astype(float), n[y].astype(float)) >= floor
            if keep.any():
                yield row, x[keep], y[keep]

    def with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, np.union1d(x, y)) for row, x, y in likely(batch)]
            rows = pa.array([row for row, own in found for _ in own], pa.int64())
            own = pa.array([i for _, own in found for i in own], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(rows) for c in place] + [batch.column(c).flatten().take(own) for c in columns], names=[*place, *columns],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n = (batch.column(c).flatten().to_numpy() for c in columns[:2])
            sets = batch.column("shingles").flatten()
            ends = np.concatenate([[0], np.cumsum(sets.value_lengths().to_numpy())])
            grams = sets.flatten().to_numpy()
            found: list[tuple[int, int]] = []
            for _, x, y in likely(batch):
                for i, j in zip(x, y, strict=True):
                    both = len(np.intersect1d(grams[ends[i] : ends[i + 1]], grams[ends[j] : ends[j + 1]], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        found.append((int(node[i]), int(node[j])))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    few = spread.select(*place, *columns)
    few = stored(met(few).select(*place, "apart", *columns).mapInArrow(with_partner, few.schema), "open-likely")
    return met(few.join(sets_of, "node"), "shingles").select("band", "apart", *columns, "shingles").mapInArrow(compare, "a long, b long")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def groups(docs: DataFrame, percent: int = 80, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``. Rows under one doc_id are one document of several texts: what
    any of them links to is in one component."""
    ship(docs.sparkSession)
    texts = _texts(docs)
    rows = _apart(texts)
    if rows is None:
        return _groups(texts, percent, k)
    rows = stored(rows, "rows-apart")
    found = stored(_groups(rows.select(F.col("__id").alias("doc_id"), "text"), percent, k), "groups-apart").withColumnRenamed("doc_id", "__id")
    own = rows.where("__id IS NOT NULL").select("__id", F.col("doc_id").alias("own"))
    ties = found.where("__id <> component_id").select(F.col("__id").alias("a"), F.col("component_id").alias("b"))
    joined = components(stored(ties.unionByName(own.where("__id <> own").select(F.col("__id").alias("a"), F.col("own").alias("b"))), "ties"))
    # Numbers of rows may lie above or below all ids; a component is named by its least real id.
    label = own.join(joined.withColumnRenamed("node", "__id"), "__id", "left").select("__id", "own", F.coalesce("component", "__id").alias("label"))
    label = stored(label, "labels")
    name = stored(label.groupBy("label").agg(F.min("own").alias("component_id")), "names")
    by_row = label.join(name, "label").select("__id", F.col("own").alias("doc_id"), "component_id")
    known = found.where("__id IS NOT NULL").select("__id", "n_shingles").join(by_row, "__id")
    known = known.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return known.unionByName(found.where("__id IS NULL").select(F.col("__id").alias("doc_id"), "n_shingles", "component_id", "kept"))


def _groups(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """:func:`groups` of rows with a doc_id each of their own, or none."""
    drawn = stored(sketches(docs, k), "sketches")
    # One row per (set, smallest id); equal sets are one class however many documents carry them.
    classes = drawn.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"))
    classes = stored(classes, "classes")
    # A doc_id is that of one row here, so the id alone finds the row; the stored ids are sent to the rows where Spark finds them few.
    nodes = stored(
        drawn.join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("node"), "n", "regs", "bands"), "nodes",
    )
    member = nodes.select("node", "n", F.posexplode("bands").alias("band", "value"))
    rank = F.xxhash64("node", "band")
    centres = (
        member.groupBy("value").agg(F.min_by("node", rank).alias("centre"), F.min_by("n", rank).alias("n_centre"), F.count("*").alias("size"))
        .where("size > 1").select("value", "centre", "n_centre")
    )
    centres = stored(centres, "centres")

    def near(n_a: str, n_b: str):
        return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))

    floor = percent / 100 - MARGIN
    grouped = stored(member.join(centres, "value"), "grouped")
    starred = grouped.where((F.col("node") != F.col("centre")) & near("n", "n_centre")).select(*_ordered("node", "centre")).distinct()
    scored = stored(_estimated(starred, nodes, floor), "scored")
    # Stored first: Spark knows the size of the ids, and where they are few enough to be broadcast no text is moved to them.
    chosen = stored(grouped.select("node").distinct(), "grouped-nodes")
    sets = stored(_sets(docs, chosen, k), "sets")

    # The best pair of every document first: they join most of what belongs together.
    ends = scored.select("a", "b", "estimate", F.explode(F.array("a", "b")).alias("node"))
    best = ends.groupBy("node").agg(F.max(F.struct("estimate", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    tried = stored(best, "tried")
    links = stored(_confirmed(tried, sets, percent), "links")
    joined = components(links)

    def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        return (
            pairs.join(labels.select(F.col("node").alias("a"), F.col("component").alias("c_a")), "a", "left")
            .join(labels.select(F.col("node").alias("b"), F.col("component").alias("c_b")), "b", "left")
            .where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
        )

    left = across(scored.select("a", "b").join(tried, ["a", "b"], "left_anti"), joined)
    more = stored(_confirmed(left, sets, percent), "links")
    if not more.isEmpty():
        links = links.unionByName(more)
        joined = components(links)

    # Groups whose members are still in several components: their members are compared across components.
    placed = stored(
        grouped.join(joined, "node", "left").select("value", "band", "node", "n", F.coalesce("component", "node").alias("component")), "placed",
    )
    open_ = placed.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    members = stored(placed.join(stored(open_.select("value"), "open-groups"), "value"), "open-members")
    more = stored(_within_open(members, percent, floor, (nodes.select("node", "regs", "bands"), sets)), "links")
    if not more.isEmpty():
        joined = components(links.unionByName(more))

    by_class = stored(
        classes.join(joined, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component_id")), "class-components"
    )
    return (
        drawn.select("doc_id", "n", "k1", "k2").join(by_class, ["k1", "k2", "n"], "left")
        .select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _apart(docs: DataFrame) -> DataFrame | None:
    """``docs`` with ``__id``, the doc_id of one row only: of rows that share a doc_id one keeps it, the others get numbers
    outside the range of ids. These rows are stored, as they are read again and must keep their numbers. None if no id is shared."""
    own = F.col("doc_id").cast("long")
    shared = docs.where(own.isNotNull()).groupBy(own.alias("__shared")).agg(F.count("*").alias("__n")).where("__n > 1").select("__shared")
    shared = stored(shared, "shared-ids")
    if shared.isEmpty():
        return None
    several = docs.withColumn("__id", own).join(shared, F.col("__id") == F.col("__shared"), "left_semi")
    several = stored(several.withColumn("__number", F.monotonically_increasing_id()), "rows-of-shared-ids")
    lead = several.groupBy("__id").agg(F.min("__number").alias("__number")).withColumn("__lead", F.lit(True))
    ends = docs.agg(F.min(own).alias("low"), F.max(own).alias("top")).first()
    other = F.lit(ends["top"]) + 1 + F.col("__number") if ends["top"] < 2**62 else F.lit(ends["low"]) - 1 - F.col("__number")
    number = F.when(F.col("__lead"), F.col("__id")).otherwise(other)
    renamed = several.join(lead, ["__id", "__number"], "left").select(*docs.columns, number.alias("__id"))
    return docs.withColumn("__id", own).join(shared, F.col("__id") == F.col("__shared"), "left_anti").unionByName(renamed)


def deduplicated(docs: DataFrame, percent: int = 80, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one row of each group and every row without doc_id. Rows under one doc_id
    stay or go by themselves."""
    ship(docs.sparkSession)
    row = "__row"
    flat = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = _apart(flat.select(row, "doc_id"))
    rows = flat.select(row, F.col("doc_id").alias("__id")) if rows is None else rows.select(row, "__id")
    found = _groups(rows.select(F.col("__id").alias("doc_id"), F.col(row)["text"].alias("text")), percent, k)
    gone = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")), "near-copies")
    return rows.join(gone, F.col("__id") == F.col("__gone"), "left_anti").select(*[F.col(row)[c].alias(c) for c in docs.columns])
