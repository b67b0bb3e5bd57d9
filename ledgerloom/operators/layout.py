"""Layout diagnostics: where the columns of a statement are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schemas as S
from ..functions import tokens as K
from ..functions.ordered import split_by_size
from ..sources.scratch import stored
from .geometry import gather_lines_by_band, grid_lines, key_grid


def _grid_lines(words: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """Grid lines. With known word counts per document only large documents move by page and band; the others stay hashed on
    ``doc_id``, as what is counted per document next is."""
    if sizes is None:
        return gather_lines_by_band(key_grid(words))
    ordinary, large, _ = split_by_size(words, "doc_id", sizes=sizes, hash_ordinary=True)
    lines = grid_lines(ordinary)
    return lines if large is None else lines.unionByName(gather_lines_by_band(key_grid(large)))


def transaction_lines(words: DataFrame, max_pages: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Grid lines that begin with a date; optionally only those of each document's first
    ``max_pages`` pages that have such a line. ``sizes``: optional known word counts (doc_id, n)."""
    lines = _grid_lines(words, sizes).filter(K.starts_with_date("line_text"))
    if max_pages is None:
        return lines
    pages = lines.select("doc_id", "page").distinct()
    first = W.partitionBy("doc_id").orderBy("page")
    wanted = pages.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= max_pages)
    return lines.join(wanted.drop("_rank"), ["doc_id", "page"], "left_semi")


def trace(lines: DataFrame) -> DataFrame:
    """The traced text of each transaction line, cut at 100 characters, with its words' places."""
    return lines.select(
        "doc_id", "page", "line_y", K.clip("line_text", 1, 100).alias("full_text"),
        F.transform("words", lambda w: F.struct(w["x0"].alias("x0"), w["text"].alias("text"))).alias("positions"),
    )


def word_roles(lines: DataFrame) -> DataFrame:
    """Each word of the transaction lines as date, amount, description or other."""
    words = lines.select("doc_id", "page", "line_y", F.explode("words").alias("w")).select(
        "doc_id", "page", "line_y", "w.x0", "w.ord", "w.text"
    )
    amount = K.strict_amount("text")
    role = (
        F.when(K.is_date("text"), "date")
        .when(F.col("text").rlike(S.AMOUNT_FORM), "amount")
        .when((F.char_length("text") > 2) & ~F.col("text").rlike(S.NUMERIC_ONLY), "description")
        .otherwise("other")
    )
    return words.withColumn("role", role).withColumn("amount", F.when(F.col("role") == "amount", amount))


def position_stats(roles: DataFrame) -> DataFrame:
    """Count, range and mean of x for each role."""
    return roles.filter(F.col("role") != "other").groupBy("doc_id", "role").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x0").alias("min_x"),
        F.max("x0").alias("max_x"),
        F.avg("x0").alias("mean_x"),
    )


def _cell(x0: str, gap: float) -> Column:
    return F.floor(F.col(x0) / gap).cast("bigint")


def position_cells(roles: DataFrame, gap: float = S.CLUSTER_GAP, max_pages: int | None = None) -> DataFrame:
    """doc_id, role, cell, min_x, max_x, sum_x, n: where the words of each role stand, in cells as wide as ``gap``.

    Positions of one cell are less than a gap apart, so they are in one cluster whatever lies between them, and their range
    is all that the clusters need to know. The counts combine before the exchange: about a dozen rows per document.
    ``max_pages``: only the first pages that show transactions; ranked on cells, not on words."""
    placed = roles.filter(F.col("x0").isNotNull() & ~F.isnan(F.col("x0").cast("double"))).withColumn("cell", _cell("x0", gap))
    first = (F.min("x0").alias("min_x"), F.max("x0").alias("max_x"), F.sum("x0").alias("sum_x"), F.count(F.lit(1)).alias("n"))
    if max_pages is None:
        return placed.groupBy("doc_id", "role", "cell").agg(*first)
    pages = placed.groupBy("doc_id", "page", "role", "cell").agg(*first)
    rank = F.dense_rank().over(W.partitionBy("doc_id").orderBy("page"))
    kept = pages.withColumn("_rank", rank).filter(F.col("_rank") <= max_pages)
    return merge_cells(kept, "doc_id", "role")


def merge_cells(cells: DataFrame, *keys: str) -> DataFrame:
    """Cells of coarser keys: ranges and counts merge in any order."""
    return cells.groupBy(*keys, "cell").agg(
        F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.sum("sum_x").alias("sum_x"), F.sum("n").alias("n")
    )


def cluster_cells(cells: DataFrame, *keys: str, gap: float = S.CLUSTER_GAP) -> DataFrame:
    """Add ``cluster``, from 1: a new one begins where a cell's first position is a gap past the last one of the cell before."""
    across = W.partitionBy(*keys).orderBy("cell")
    jump = F.coalesce((F.col("min_x") - F.lag("max_x").over(across) >= gap).cast("int"), F.lit(1))
    numbered = F.sum("_jump").over(across.rowsBetween(W.unboundedPreceding, 0)).cast("int")
    return cells.withColumn("_jump", jump).withColumn("cluster", numbered).drop("_jump")


def amount_positions(roles: DataFrame, gap: float = S.CLUSTER_GAP) -> DataFrame:
    """Cells of amounts per document with their cluster number."""
    cells = position_cells(roles.filter(F.col("role") == "amount"), gap)
    return cluster_cells(cells, "doc_id", gap=gap)


def cluster_stats(positions: DataFrame) -> DataFrame:
    """Range, mean and count of each amount cluster."""
    return positions.groupBy("doc_id", "cluster").agg(
        F.min("min_x").alias("min_x"),
        F.max("max_x").alias("max_x"),
        (F.sum("sum_x") / F.sum("n")).alias("mean_x"),
        F.sum("n").alias("n"),
    )


def cluster_samples(roles: DataFrame, positions: DataFrame, size: int = 5, gap: float = S.CLUSTER_GAP) -> DataFrame:
    """The first ``size`` amounts of each cluster in x order, ties in reading order.

    Ranked per cell first: the rank limit is applied before rows are exchanged, so a column
    with very many amounts sends only ``size`` of them on from each task.
    """
    order = ("x0", "page", "line_y", "ord")
    amounts = roles.filter(F.col("role") == "amount").withColumn("cell", _cell("x0", gap))
    near = W.partitionBy("doc_id", "cell").orderBy(*order)
    few = amounts.withColumn("_r", F.row_number().over(near)).filter(F.col("_r") <= size).drop("_r")
    few = few.join(positions.select("doc_id", "cell", "cluster"), ["doc_id", "cell"])
    wide = W.partitionBy("doc_id", "cluster").orderBy(*order)
    few = few.withColumn("_r", F.row_number().over(wide)).filter(F.col("_r") <= size)
    return few.groupBy("doc_id", "cluster").agg(
        F.sort_array(F.collect_list(F.struct("_r", "amount")))["amount"].alias("sample_amounts")
    )


def clusters(roles: DataFrame, size: int = 5, gap: float = S.CLUSTER_GAP) -> DataFrame:
    """Range, mean, count and first amounts of each amount cluster. The amounts are stored, so that the words are
    put in lines once for both."""
    amounts = stored(roles.filter(F.col("role") == "amount").select("doc_id", "page", "line_y", "x0", "ord", "role", "amount"), "amounts")
    at = amount_positions(amounts, gap)
    return cluster_stats(at).join(cluster_samples(amounts, at, size, gap), ["doc_id", "cluster"])


def column_bounds(roles: DataFrame, gap: float = S.CLUSTER_GAP, margin: float = S.BOUND_MARGIN, max_pages: int | None = None) -> DataFrame:
    """Recommended column edges for documents that show dates, descriptions and amounts, from one look at the words."""
    return bounds_of(position_cells(roles, gap, max_pages), gap, margin)


def bounds_of(cells: DataFrame, gap: float = S.CLUSTER_GAP, margin: float = S.BOUND_MARGIN) -> DataFrame:
    """Column edges from :func:`position_cells`."""
    at = cluster_cells(cells, "doc_id", "role", gap=gap)
    of = lambda role, c: F.when(F.col("role") == role, F.col(c))
    inside = lambda i, c: F.sum(F.when((F.col("role") == "amount") & (F.col("cluster") == i), F.col(c)))
    mean = lambda i: inside(i, "sum_x") / inside(i, "n")
    wide = at.groupBy("doc_id").agg(
        F.max(of("date", "max_x")).alias("_date_max"), F.min(of("description", "min_x")).alias("_desc_min"),
        F.max(of("amount", "cluster")).alias("n_clusters"), mean(1).alias("_m1"), mean(2).alias("_m2"), mean(3).alias("_m3"),
    )
    n = F.col("n_clusters")
    edge = lambda c: F.col(c) - margin
    return (
        wide.filter(F.col("_date_max").isNotNull() & F.col("_desc_min").isNotNull() & n.isNotNull())
        .select(
            "doc_id", "n_clusters",
            (F.col("_date_max") + margin).alias("date_right_x"),
            edge("_desc_min").alias("description_x"),
            edge("_m1").alias("description_right_x"),
            F.when(n >= 3, edge("_m1")).alias("withdrawal_x"),
            F.when(n >= 3, edge("_m2")).alias("deposit_x"),
            F.when(n == 2, edge("_m1")).alias("amount_x"),
            F.when(n >= 3, edge("_m3")).when(n == 2, edge("_m2")).otherwise(edge("_m1")).alias("balance_x"),
        )
    )


def profile_from_bounds(bounds: DataFrame) -> DataFrame:
    """Column profile for ``geometry.type_words``, from documents that show all three columns."""
    return bounds.filter(F.col("n_clusters") >= 3).select("doc_id", "withdrawal_x", "deposit_x", "balance_x")


def single_amount_profile(bounds: DataFrame) -> DataFrame:
    """Column profile of documents with one amount column and a balance: all amounts are read into the first side, and
    ``ledger.infer_sides`` places them."""
    two = bounds.filter(F.col("n_clusters") == 2)
    return two.select("doc_id", F.col("amount_x").alias("withdrawal_x"), F.col("balance_x").alias("deposit_x"), "balance_x")


def inspect_area(words: DataFrame, page: int = 2, y_range: tuple[float, float] = (240.0, 350.0)) -> DataFrame:
    """Lines of one area of one page, for every document. Both limits belong to the area."""
    lo, hi = y_range
    area = words.filter((F.col("page") == page) & F.col("y0").between(lo, hi))
    return grid_lines(area)
