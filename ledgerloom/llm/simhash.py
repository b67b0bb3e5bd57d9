"""Near-duplicates by 64-bit fingerprints within a Hamming distance, found over a Gray-order hierarchical index.

A fingerprint bit is set where it is set in over half of the XXH64 values (seed 42) of a text's word shingles, repeats
included. Distinct fingerprints are sorted by Gray rank, so that neighbours differ in few bits, and cut into blocks of
at most ``BLOCK``. A node of the index holds the bits that all fingerprints below it share, as a mask and a pattern; bits
that its parent has already are not compared again. Two nodes are held against each other on the bits that both have: the
differences add up from level to level, and a pair of nodes that is over the bound goes with all that is below it.

1. Upper levels, of ``FAN`` nodes each, are tables joined level by level: a pair of nodes gives the pairs of its children
   that are still within the bound. Down to the blocks this moves masks and patterns only.
2. Pairs of blocks that are left are compared inside tasks down their lower levels (``STEPS`` fingerprints a node).
3. Links that would not join anything new within a pair of blocks are left out, and groups that are joined already
   are not compared, so a cluster of any size gives fewer links than it has fingerprints per pair of blocks.

The result is exact: no sampling, no caps.

Defined results: null and empty texts, and texts without words, have the fingerprint zero and are linked like any other;
rows without doc_id have a fingerprint, take no part in links and have no component; rows that share a doc_id are one
document in all components; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored
from .components import components
from .shipping import ship

SHINGLE, SEED, BOUND = 3, 42, 3
#: Fingerprints of a block, children of an upper node, fingerprints of a node on the lower levels of a block.
BLOCK, FAN, STEPS = 4_096, 32, (64, 8)
#: Pairs compared at once.
CHUNK = 1 << 18
#: Hash values counted at once.
HASHES = 1 << 16

_U = np.uint64


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of every run of k words, joined by blanks; of the whole sequence where there are fewer."""
    words = (text or "").encode().lower().split()  # both treat ASCII only
    if not words:
        return np.zeros(0, _U)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - k + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), _U, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the values, as an unsigned number."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES):
        part = hashes[at : at + HASHES].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""
    ship(docs.sparkSession)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([majority(shingle_hashes(t.as_py(), k)) for t in batch.column(1)], _U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(drawn, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of a fingerprint in Gray order, as a long that sorts alike."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(2**63)).cast("long"))


# --- inside a task --------------------------------------------------------
class Tree:
    """The lower levels of a block: per level the nodes' shared bits (mask) and their values (pattern)."""

    def __init__(self, fps: np.ndarray):
        self.fps, self.levels = fps, []
        for step in STEPS:
            starts = np.arange(0, len(fps), step)
            both, any_ = np.bitwise_and.reduceat(fps, starts), np.bitwise_or.reduceat(fps, starts)
            self.levels.append((~(both ^ any_), both, starts))
        self.levels.append((np.full(len(fps), ~_U(0)), fps, np.arange(len(fps))))


class Sets:
    """Which fingerprints of a task are joined; ``top`` names the set of each."""

    def __init__(self, top: np.ndarray):
        self.top = top

    def join(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """Join the pairs; returns those that were needed."""
        used = []
        while len(x):
            a, b = self.top[x], self.top[y]
            open_ = a != b
            x, y, a, b = x[open_], y[open_], a[open_], b[open_]
            if not len(x):
                break
            # One link for each greater set at a time: they cannot form a circle, as each leads to a lesser one.
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            _, first = np.unique(hi, return_index=True)
            used += zip(x[first].tolist(), y[first].tolist(), strict=True)
            parent = np.arange(len(self.top))
            parent[hi[first]] = lo[first]
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.top = parent[self.top]
        return used


def _children(at: np.ndarray, step: int, finer: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the parent in ``at``, node) of all children of the nodes ``at``: nodes of ``step`` to nodes of ``finer``."""
    per = step // finer
    child = at[:, None] * per + np.arange(per)[None]
    inside = child * finer < n
    return np.nonzero(inside)[0], child[inside]


def linked(p: Tree, q: Tree, sets: Sets, offset: int, bound: int = BOUND) -> list[tuple[int, int]]:
    """Links between the fingerprints of p and q (the same tree: within it) that join sets; q's numbers begin at ``offset``."""
    same, steps, used = p is q, (*STEPS, 1), []

    def edges(tree: Tree, base: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        own = sets.top[base : base + len(tree.fps)]
        return np.minimum.reduceat(own, tree.levels[level][2]), np.maximum.reduceat(own, tree.levels[level][2])

    def down(level: int, a: np.ndarray, b: np.ndarray, common: np.ndarray, apart: np.ndarray) -> None:
        """Pairs of nodes (a, b) of one level, the bits on which their parents were compared and the differences there."""
        nonlocal used
        (mask_p, bits_p, _), (mask_q, bits_q, _) = p.levels[level], q.levels[level]
        both = mask_p[a] & mask_q[b]
        apart = apart + np.bitwise_count((bits_p[a] ^ bits_q[b]) & both & ~common)
        keep = apart <= bound
        if same:
            keep &= a <= b if level < len(STEPS) else a < b
        a, b, both, apart = a[keep], b[keep], both[keep], apart[keep]
        if not len(a):
            return
        if level == len(STEPS):
            used += sets.join(a, b + offset)
            return
        (lo_p, hi_p), (lo_q, hi_q) = edges(p, 0, level), edges(q, offset, level)
        joined = (lo_p[a] == hi_p[a]) & (lo_q[b] == hi_q[b]) & (lo_p[a] == lo_q[b])
        a, b, both, apart = a[~joined], b[~joined], both[~joined], apart[~joined]
        per = (steps[level] // steps[level + 1]) ** 2
        for at in range(0, len(a), max(1, CHUNK // per)):
            cut = slice(at, at + max(1, CHUNK // per))
            x, y, known, far = a[cut], b[cut], both[cut], apart[cut]
            if level == len(STEPS) - 1:  # sets may have met since
                (lo_p, hi_p), (lo_q, hi_q) = edges(p, 0, level), edges(q, offset, level)
                open_ = ~((lo_p[x] == hi_p[x]) & (lo_q[y] == hi_q[y]) & (lo_p[x] == lo_q[y]))
                x, y, known, far = x[open_], y[open_], known[open_], far[open_]
            i, x = _children(x, steps[level], steps[level + 1], len(p.fps))
            j, z = _children(y[i], steps[level], steps[level + 1], len(q.fps))
            down(level + 1, x[j], z, known[i][j], far[i][j])

    n, m = len(p.levels[0][0]), len(q.levels[0][0])
    a, b = (v.ravel() for v in np.meshgrid(np.arange(n), np.arange(m), indexing="ij"))
    down(0, a, b, np.zeros(len(a), _U), np.zeros(len(a), np.int64))
    return used


_BLOCKS = "part int, seq long, both long, some long, fps binary, tops binary, x array<long>, y array<long>"


def _cut(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Sorted fingerprints to blocks with the sets inside them and the links that make these."""
    part, seq, held = TaskContext.get().partitionId(), 0, np.zeros(0, _U)

    def told(fps: np.ndarray) -> pa.RecordBatch:
        nonlocal seq
        tree, sets = Tree(fps), Sets(np.arange(len(fps)))
        links = np.array(linked(tree, tree, sets, 0), np.int64).reshape(-1, 2)
        signed = fps.view(np.int64)
        row = {
            "part": part, "seq": seq, "both": int(np.bitwise_and.reduce(fps).view(np.int64)), "some": int(np.bitwise_or.reduce(fps).view(np.int64)),
            "fps": fps.astype("<u8").tobytes(), "tops": sets.top.astype("<u2").tobytes(), "x": signed[links[:, 0]].tolist(), "y": signed[links[:, 1]].tolist(),
        }
        seq += 1
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("both", pa.int64()), ("some", pa.int64()), ("fps", pa.binary()), ("tops", pa.binary()), ("x", pa.list_(pa.int64())), ("y", pa.list_(pa.int64()))])
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        held = np.concatenate([held, batch.column(0).to_numpy().view(_U)])
        while len(held) >= block:
            yield told(held[:block])
            held = held[block:]
    if len(held):
        yield told(held)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks to the links between them that join sets."""
    for batch in batches:
        xs, ys = [], []
        for r in range(batch.num_rows):
            p, q = (np.frombuffer(batch.column(c)[r].as_py(), "<u8") for c in ("fps_a", "fps_b"))
            own, other = (np.frombuffer(batch.column(c)[r].as_py(), "<u2").astype(np.int64) for c in ("tops_a", "tops_b"))
            found = np.array(linked(Tree(p), Tree(q), Sets(np.concatenate([own, other + len(p)])), len(p)), np.int64).reshape(-1, 2)
            # A link that joins sets always has one end in each block.
            xs.append(p[found[:, 0]].view(np.int64))
            ys.append(q[found[:, 1] - len(p)].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in (xs, ys)], names=["x", "y"])


# --- over all tasks -------------------------------------------------------
def _numbered(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``node``, a dense number in Gray order; one row per partition is ordered to get it."""
    sizes = blocks.groupBy("part").agg(F.count("*").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return blocks.join(before, "part").withColumn("node", F.col("before") + F.col("seq")).drop("before")


def block_pairs(blocks: DataFrame, bound: int = BOUND) -> DataFrame:
    """(a, b), a < b: the blocks whose shared bits allow a link, found from the root of the index down."""
    leaves = stored(blocks.select("node", "both", "some"), "index-leaves")
    n = leaves.count()
    height = 0
    while FAN**height < n:
        height += 1

    def level(k: int) -> DataFrame:
        node = F.floor(F.col("node") / F.lit(FAN**k)).cast("long")
        nodes = leaves if k == 0 else leaves.groupBy(node.alias("node")).agg(F.bit_and("both").alias("both"), F.bit_or("some").alias("some"))
        mask = F.bitwise_not(F.col("both").bitwiseXOR(F.col("some")))
        return nodes.select("node", F.floor(F.col("node") / FAN).cast("long").alias("parent"), mask.alias("mask"), F.col("both").alias("bits"))

    zero = F.lit(0).cast("long")
    # Stored, so that the first step is a join on keys and not one on constants.
    pairs = stored(leaves.limit(1).select(zero.alias("a"), zero.alias("b"), zero.alias("common"), F.lit(0).alias("apart")), "root-pair")
    for k in range(height - 1, -1, -1):
        nodes = level(k)
        left, right = (nodes.select(F.col("node").alias(f"{s}_node"), F.col("parent").alias(s), F.col("mask").alias(f"{s}_mask"), F.col("bits").alias(f"{s}_bits")) for s in "ab")
        both = F.col("a_mask").bitwiseAND(F.col("b_mask"))
        differ = F.col("a_bits").bitwiseXOR(F.col("b_bits")).bitwiseAND(both).bitwiseAND(F.bitwise_not(F.col("common")))
        met = pairs.join(left, "a").join(right, "b").where("a_node <= b_node")
        met = met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), both.alias("common"), (F.col("apart") + F.bit_count(differ)).alias("apart"))
        pairs = stored(met.where(F.col("apart") <= bound), "node-pairs")
    return pairs.where("a < b").select("a", "b")


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(x, y): fingerprints within ``BOUND`` of each other, as many pairs as it takes to join all that belong together.

    ``distinct``: fp, each once."""
    ship(distinct.sparkSession)
    parts = max(1, -(-distinct.count() // (4 * block)))
    dealt = distinct.select("fp", gray_rank(F.col("fp")).alias("rank")).repartitionByRange(parts, "rank").sortWithinPartitions("rank")
    blocks = stored(_numbered(stored(dealt.select("fp").mapInArrow(lambda b: _cut(b, block), _BLOCKS), "blocks")), "numbered-blocks")
    inside = blocks.select(F.explode(F.arrays_zip("x", "y")).alias("l")).select("l.x", "l.y")
    side = {s: blocks.select(F.col("node").alias(s), F.col("fps").alias(f"fps_{s}"), F.col("tops").alias(f"tops_{s}")) for s in "ab"}
    met = block_pairs(blocks).join(side["a"], "a").join(side["b"], "b")
    between = met.select("fps_a", "tops_a", "fps_b", "tops_b").mapInArrow(_match, "x long, y long")
    return inside.unionByName(between)


def groups(docs: DataFrame, k: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, fp, component_id of every row of ``docs``."""
    drawn = stored(fingerprints(docs, k), "fingerprints")
    known = drawn.where(F.col("doc_id").isNotNull())
    # A fingerprint is known by the smallest doc_id that carries it; one id may stand for several.
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-classes")
    found = stored(links(classes.select("fp"), block), "fingerprint-links")
    ends = found.join(classes.select(F.col("fp").alias("x"), F.col("node").alias("a")), "x").join(classes.select(F.col("fp").alias("y"), F.col("node").alias("b")), "y")
    shared = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    carried = known.join(shared, "doc_id", "left_semi").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    joined = components(ends.select("a", "b").unionByName(carried))
    by_class = stored(
        classes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "class-components"
    )
    return drawn.join(by_class, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
