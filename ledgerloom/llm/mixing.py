"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised. The exponent is found by nested section of
an interval: each pass evaluates a grid of exponents in one aggregation over the sources and keeps the bracket
around the target, so only one row of sums per pass reaches the driver, however many sources there are.

The weights turn into copies of documents: a source with budget b and t tokens gets ``floor(b / t)`` whole epochs; the
rest is taken from a permutation of its documents. The permutation has two levels: documents fall into blocks by hash, and
blocks are taken in order until the one that crosses the budget, in which documents are taken in hash order. So
no task ever orders a source as a whole. A row's copies follow from its own key, its source's plan and the few
units of edge blocks, so rows and their texts are never moved.

Defined results: a null source is a source of its own; null or empty texts have no tokens and get the whole epochs of
their source only; rows equal in doc_id, source and text are one unit of the mix: its copies are taken together and
count with all their tokens; an empty table gives an empty result. Other columns are kept by :func:`mixed` and
never read. Everything is built-in expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored

#: Tokens of a block of the permutation, and the most blocks of a source.
BLOCK_TOKENS, MAX_BLOCKS = 50_000, 65_536
GRID, PASSES = 32, 6
#: Rows of a small table (sources; units of edge blocks) up to which it is sent to every executor: 100,000 rows of at most a few MB.
SENT = 100_000


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII blanks: blanks that follow a word or the end, counted by what they leave."""
    words = F.split(F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")), " +", -1)
    return F.when(F.element_at(words, 1) == "", F.lit(0)).otherwise(F.size(words)).cast("long")


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"))


def units(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """row_key, source, n_tokens (of all equal rows together)."""
    return docs.select(_row_key().alias("row_key"), F.col("source").cast("string").alias("source"), _tokens(tokens).alias("n")).groupBy("row_key", "source").agg(F.sum("n").alias("n_tokens"))


def exponent(totals: DataFrame, budget: float | None, entropy: float | None, repetition: float | None) -> float:
    """The exponent for sources with ``t`` tokens each.

    ``entropy``: wanted entropy of the weights as a share of that of equal weights. ``repetition``: the most epochs of any source;
    the least exponent in [0, 1] that respects it. ``budget``: tokens in all; None: the least budget that drops nothing.
    With both targets the limit wins where they disagree."""
    whole = totals.agg(F.sum("t").cast("double").alias("t"), F.max("t").cast("double").alias("top"), F.count("*").alias("n")).first()
    if not whole["n"]:
        return 1.0
    p = F.col("t") / F.lit(whole["t"])

    def search(lo: float, hi: float, value, falls_below: float) -> float:
        """Least exponent in [lo, hi] whose value is at most ``falls_below``; values fall with the exponent."""
        for _ in range(PASSES):
            grid = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
            sums = totals.agg(
                *[F.sum(F.pow(p, a)).alias(f"z{i}") for i, a in enumerate(grid)],
                *[F.sum(F.pow(p, a) * F.log(p)).alias(f"s{i}") for i, a in enumerate(grid)],
                F.min("t").cast("double").alias("least"),
            ).first()
            values = [value(a, sums[f"z{i}"], sums[f"s{i}"], sums["least"]) for i, a in enumerate(grid)]
            good = [i for i, v in enumerate(values) if v <= falls_below + 1e-12]
            if not good:
                return hi
            if good[0] == 0:
                return lo
            lo, hi = grid[good[0] - 1], grid[good[0]]
        return hi

    def entropy_of(a: float, z: float, s: float, _: float) -> float:
        return math.log(z) - a * s / z

    def most_epochs(a: float, z: float, _: float, least: float) -> float:
        epochs = (least / whole["t"]) ** (a - 1)
        return epochs / (whole["top"] / whole["t"]) ** (a - 1) if budget is None else epochs * budget / (z * whole["t"])

    found = [0.0 if entropy is None and repetition is not None else 1.0]
    if entropy is not None:
        found = [search(0.0, 8.0, entropy_of, entropy * math.log(whole["n"]) if whole["n"] > 1 else 0.0)]
    if repetition is not None:
        found.append(search(0.0, 1.0, most_epochs, repetition))
    return max(found)


def settled(unit: DataFrame, budget: float | None = None, entropy: float | None = None, repetition: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """What decides the copies of every row, as two small stored tables: per source (__s, whole, epochs, blocks, edge_block), and
    the units (edge_key) that are taken from each source's edge block, the one in which its budget ends."""
    totals = stored(unit.groupBy("source").agg(F.sum("n_tokens").alias("t")), "source-totals")
    some = totals.where("t > 0")
    alpha = exponent(some, budget, entropy, repetition)
    sums = some.agg(F.sum("t").cast("double").alias("t"), F.max("t").cast("double").alias("top")).first()
    t_all, t_top = float(sums["t"] or 1.0), float(sums["top"] or 1.0)
    p = F.col("t") / F.lit(t_all)
    if budget is None:
        epochs = F.pow(p / F.lit(t_top / t_all), alpha - 1)
    else:
        z = some.agg(F.sum(F.pow(p, alpha)).alias("z")).first()["z"] or 1.0
        epochs = F.pow(p, alpha - 1) * F.lit(budget / (z * t_all))
    weights = totals.select(
        _source_key(F.col("source")).alias("__s"), "t", F.when(F.col("t") > 0, epochs).otherwise(F.lit(1.0)).alias("epochs"),
        F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("t") / BLOCK_TOKENS))).cast("long").alias("blocks"),
    )
    whole = F.floor(F.col("epochs") + 1e-9)
    weights = stored(weights.withColumns({"whole": whole, "left": (F.col("epochs") - whole) * F.col("t")}), "weights")
    placed = _beside(unit.select("row_key", "n_tokens", _source_key(F.col("source")).alias("__s")), weights, "__s").select(
        "row_key", "__s", "n_tokens", "left", _block(F.col("row_key"), seed).alias("block"),
    )
    placed = stored(placed, "placed-units")
    filled = placed.groupBy("__s", "block").agg(F.sum("n_tokens").alias("size"), F.max("left").alias("left"))
    ahead = Window.partitionBy("__s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per block of at least BLOCK_TOKENS on average, and at most MAX_BLOCKS of a source, meet in the window.
    filled = filled.withColumn("before", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    edge = stored(
        filled.where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("size") > F.col("left"))).select("__s", "block", "before"), "edges",
    )
    crossed = placed.join(edge, ["__s", "block"])
    inner = Window.partitionBy("__s").orderBy(_turn(F.col("row_key"), seed), "row_key").rowsBetween(Window.unboundedPreceding, 0)
    taken = stored(
        crossed.withColumn("used", F.col("before") + F.sum("n_tokens").over(inner)).where((F.col("used") <= F.col("left")) & (F.col("n_tokens") > 0))
        .select(F.col("row_key").alias("edge_key")), "edge-units",
    )
    full = edge.groupBy("__s").agg(F.min("block").alias("edge_block"))
    return stored(weights.select("__s", "epochs", "whole", "blocks").join(full, "__s", "left"), "source-plans"), taken


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def _block(key: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.col("blocks"))


def _turn(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed), F.lit(1))


def _beside(rows: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Rows with a stored table joined on: sent to every executor where it has at most ``SENT`` rows (checked), else joined by hash."""
    return rows.join(F.broadcast(small) if small.limit(SENT + 1).count() <= SENT else small, key, how)


def _decided(rows: DataFrame, plans: DataFrame, taken: DataFrame, seed: int) -> DataFrame:
    """``rows`` (row_key, __s, n_tokens and others) with copies, epochs and spot (place in the source's permutation, 0 to 1): all
    from the row's own key and two small tables, so that no row is moved."""
    key = F.col("row_key")
    marked = _beside(_beside(rows.withColumn("edge_key", key), plans, "__s"), taken.withColumn("in_edge", F.lit(True)), "edge_key", "left")
    extra = (F.col("n_tokens") > 0) & ((_block(key, seed) < F.col("edge_block")) | F.col("in_edge"))
    u = (F.shiftright(_turn(key, seed), 11) + F.lit(2.0**52)) / F.lit(2.0**53)
    return marked.withColumns({
        "copies": (F.col("whole") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0)).cast("long"),
        "spot": (_block(key, seed) + u) / F.col("blocks"),
    })


def plan(unit: DataFrame, budget: float | None = None, entropy: float | None = None, repetition: float | None = None, seed: int = 0) -> DataFrame:
    """row_key, copies, epochs (real number of epochs of the source), spot (place in the source's permutation, 0 to 1)."""
    rows = unit.select("row_key", _source_key(F.col("source")).alias("__s"), "n_tokens")
    return _decided(rows, *settled(unit, budget, entropy, repetition, seed), seed).select("row_key", "copies", "epochs", "spot")


def _tokens(tokens: Column | None) -> Column:
    return word_count(F.col("text")) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))


def mixed(
    docs: DataFrame, budget: float | None = None, entropy: float | None = None, repetition: float | None = None, seed: int = 0,
    tokens: Column | None = None, order: str | None = None,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns; dropped where it takes none.

    ``order`` names a further column with the place of each copy in the mixed stream (as in :func:`decisions`)."""
    found = settled(stored(units(docs, tokens), "units"), budget, entropy, repetition, seed)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), _row_key().alias("row_key"), _source_key(F.col("source")).alias("__s"), _tokens(tokens).alias("n_tokens"),
    )
    chosen = _decided(rows, *found, seed).where("copies > 0")
    out = chosen.select("row", "spot", "epochs", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    place = [] if order is None else [((F.col("spot") + F.col("copy") - 1) / F.col("epochs")).alias(order)]
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], *place)


def decisions(docs: DataFrame, budget_share: float | None = None, entropy: float | None = None, repetition: float | None = None, seed: int = 0) -> DataFrame:
    """doc_id, source, n_tokens, copies, mix_order of the first copy, for every row of ``docs``.

    Copy e (from 0) of a document has the order ``mix_order + e / epochs``: sorted by it, every stretch of the stream
    holds the sources in their weights. ``budget_share``: the budget as a share of all tokens."""
    unit = stored(units(docs), "units")
    budget = None
    if budget_share is not None:
        budget = budget_share * float(unit.agg(F.sum("n_tokens").alias("t")).first()["t"] or 0)
    found = settled(unit, budget, entropy, repetition, seed)
    rows = docs.select(
        "doc_id", "source", _row_key().alias("row_key"), _source_key(F.col("source")).alias("__s"), word_count(F.col("text")).alias("n_tokens"),
    )
    return _decided(rows, *found, seed).select(
        "doc_id", "source", "n_tokens", "copies", F.when(F.col("copies") > 0, F.col("spot") / F.col("epochs")).alias("mix_order"), "epochs",
    )
