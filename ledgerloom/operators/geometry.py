"""Positioned words -> lines -> typed words.

Line assembly never gathers a page: a line row is the largest value built here, and the table
stage works on line rows. Line keys of one page lie at least ``tolerance`` apart, so a page has
no more lines than its height allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schemas as S
from ..functions import tokens as K
from ..functions.ordered import prefix_scan, with_previous
from ..sources.scratch import stored

#: Height of a band of lines that stay together: above that of any printed page.
BAND = 2_000.0


def flip_origin(words: DataFrame, page_height: str | Column = "page_height") -> DataFrame:
    """Bottom-left coordinates to top-left ones."""
    h = F.col(page_height) if isinstance(page_height, str) else page_height
    return words.withColumns({"y0": h - F.col("y1"), "y1": h - F.col("y0")})


def type_words(words: DataFrame, profile: S.ColumnProfile | DataFrame = S.DEFAULT_PROFILE) -> DataFrame:
    """Add ``amount`` and ``col`` to each word, once, before any grouping.

    ``profile`` is either one layout for all, or a table ``doc_id, withdrawal_x, deposit_x,
    balance_x`` (see ``layout.profile_from_bounds``); documents missing there use the default.
    """
    d = S.DEFAULT_PROFILE
    if isinstance(profile, DataFrame):
        words = words.join(profile, "doc_id", "left")
        edges = [
            F.coalesce(F.col("withdrawal_x"), F.lit(d.withdrawal_x)),
            F.coalesce(F.col("deposit_x"), F.lit(d.deposit_x)),
            F.coalesce(F.col("balance_x"), F.lit(d.balance_x)),
        ]
    else:
        edges = [F.lit(profile.withdrawal_x), F.lit(profile.deposit_x), F.lit(profile.balance_x)]
    typed = words.withColumn("amount", K.amount("text"))
    is_amount = F.col("amount").isNotNull()
    typed = typed.withColumn("col", F.when(is_amount, K.column_of("x0", *edges)))
    return typed.drop("withdrawal_x", "deposit_x", "balance_x") if isinstance(profile, DataFrame) else typed


def _first_keys(points: Column, tolerance: float) -> Column:
    """Line keys of one run: points in extraction order, each kept unless a kept one is near."""
    near = lambda p: lambda k: F.abs(k - p["y0"]) < tolerance
    return F.aggregate(
        F.sort_array(points),
        F.array().cast("array<double>"),
        lambda keys, p: F.when(F.exists(keys, near(p)), keys).otherwise(
            F.concat(keys, F.array(p["y0"]))
        ),
    )


def _nearest_first(keys: Column, y: Column, tolerance: float) -> Column:
    return F.get(F.filter(keys, lambda k: F.abs(k - y) < tolerance), F.lit(0))


def _runs(ys: DataFrame, tolerance: float, *order: str) -> DataFrame:
    """Add ``_run``: sorted by y, a gap of ``tolerance`` or more starts a new run. Runs cannot
    influence each other's lines."""
    down = W.partitionBy("doc_id", "page").orderBy("y0", *order)
    apart = F.coalesce((F.col("y0") - F.lag("y0").over(down) >= tolerance).cast("int"), F.lit(1))
    return ys.withColumn("_apart", apart).withColumn(
        "_run", F.sum("_apart").over(down.rowsBetween(W.unboundedPreceding, 0))
    ).drop("_apart")


def _runs_spread(ys: DataFrame, tolerance: float, band: float = BAND) -> DataFrame:
    """:func:`_runs` of the distinct y values of a page, ordered within bands only: the first value of a band looks at the
    last one of the nearest earlier band, and the runs that earlier bands started are added."""
    ys = stored(ys, "levels").withColumn("_page", F.struct("doc_id", "page"))
    ys = with_previous(ys, "_page", "y0", {"_above": "y0"}, int(band))
    apart = F.coalesce((F.col("y0") - F.col("_above") >= tolerance).cast("bigint"), F.lit(1).cast("bigint"))
    ys = ys.withColumns({"_apart": apart, "_band": F.floor(F.col("y0") / band)})
    return prefix_scan(ys, "_page", ["_band", "y0"], {"_run": F.col("_apart")}).drop("_page", "_band", "_apart", "_above")


def gather_runs(words: DataFrame, tolerance: float = S.LINE_TOLERANCE, *extra: str) -> DataFrame:
    """Lines by the first-key rule: a word joins the first-created line within ``tolerance``.

    A run lower than ``tolerance`` is one line whose key is the y of its first word, and nearly
    all runs are. A higher run is divided: its distinct y values are compared in extraction
    order, and each word goes to the first key near it. Everything is partitioned by document
    and page, so an input hashed on the document passes through without a shuffle.
    """
    # A word is one value before it is ordered and gathered.
    words = words.select("doc_id", "page", "y0", "ord", F.struct("x0", "ord", "text", *extra, "y0").alias("_word"))
    runs = _runs(words, tolerance, "ord").groupBy("doc_id", "page", "_run").agg(
        F.sort_array(F.collect_list("_word")).alias("words"),
        F.min_by("y0", "ord").alias("_first"),
        (F.max("y0") - F.min("y0")).alias("_height"),
    )
    points = F.transform("words", lambda w: F.struct(w["ord"].alias("ord"), w["y0"].alias("y0")))
    keys = F.when(F.col("_height") >= tolerance, _first_keys(points, tolerance)).otherwise(F.array("_first"))
    runs = runs.withColumn("_keys", keys)
    # A run always has keys; a plain explode would add a filter on their number, for which they are found twice.
    # Each word of a higher run looks for its key once; dividing the run then compares places.
    at = F.transform("words", lambda w: _nearest_first(F.col("_keys"), w["y0"], tolerance))
    runs = runs.withColumn("_at", F.when(F.size("_keys") > 1, at))
    runs = runs.select("doc_id", "page", "words", "_at", F.explode_outer("_keys").alias("line_y"))
    mine = F.filter("words", lambda w, i: F.get(F.col("_at"), i) == F.col("line_y"))
    lines = runs.select(
        "doc_id", "page", "line_y", F.when(F.col("_at").isNull(), F.col("words")).otherwise(mine).alias("words")
    )
    return lines.withColumn("line_text", F.array_join(F.col("words.text"), " "))


def key_lines_spread(words: DataFrame, tolerance: float = S.LINE_TOLERANCE) -> DataFrame:
    """Add ``line_y`` by the same rule as :func:`gather_runs`, for documents of any size.

    Words are first reduced to the distinct y values of a page (combined before the shuffle), the
    keys are found on those, and words pick them up by an equi-join on (document, page, y), which
    spreads one overfull page over many tasks.
    """
    levels = words.groupBy("doc_id", "page", "y0").agg(F.min("ord").alias("ord"))
    levels = _runs_spread(levels, tolerance)
    runs = levels.groupBy("doc_id", "page", "_run").agg(
        F.collect_list(F.struct("ord", "y0")).alias("_points")
    )
    runs = runs.withColumn("_keys", _first_keys(F.col("_points"), tolerance))
    keyed = runs.select("doc_id", "page", "_keys", F.explode("_points.y0").alias("y0"))
    keyed = keyed.select(
        "doc_id", "page", "y0",
        _nearest_first(F.col("_keys"), F.col("y0"), tolerance).alias("line_y"),
    )
    return words.join(keyed, ["doc_id", "page", "y0"])


def key_grid(words: DataFrame, step: float = S.LINE_TOLERANCE) -> DataFrame:
    """Add ``line_y`` by rounding y to a grid, half to even."""
    return words.withColumn("line_y", F.rint(F.col("y0") / step) * step)


def gather_lines(keyed: DataFrame, *extra: str) -> DataFrame:
    """One row per line: its words left to right (ties in extraction order) and its text."""
    word = F.struct("x0", "ord", "text", *extra)
    lines = keyed.groupBy("doc_id", "page", "line_y").agg(
        F.sort_array(F.collect_list(word)).alias("words")
    )
    return lines.withColumn("line_text", F.array_join(F.col("words.text"), " "))


def gather_lines_by_band(keyed: DataFrame, band: float = BAND) -> DataFrame:
    """The same lines, those of an ordinary page in one task and those of a higher one by bands of ``band`` points, so
    that what is counted per page or document next is combined before it is exchanged."""
    banded = keyed.withColumn("_band", F.floor(F.col("line_y") / band)).repartition("doc_id", "page", "_band")
    lines = banded.groupBy("doc_id", "page", "_band", "line_y").agg(
        F.sort_array(F.collect_list(F.struct("x0", "ord", "text"))).alias("words")
    )
    return lines.drop("_band").withColumn("line_text", F.array_join(F.col("words.text"), " "))


def greedy_lines(words: DataFrame, spread: bool = False, tolerance: float = S.LINE_TOLERANCE,
                 extra: tuple[str, ...] = ("amount", "col")) -> DataFrame:
    """Lines of typed words by the first-key rule; ``spread`` for documents of any size. ``extra``: what words carry along."""
    if spread:
        return gather_lines(key_lines_spread(words, tolerance), *extra, "y0")
    return gather_runs(words, tolerance, *extra)


def grid_lines(words: DataFrame, step: float = S.LINE_TOLERANCE) -> DataFrame:
    """Lines by the grid rule, as the layout diagnostics use them."""
    return gather_lines(key_grid(words, step))


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_idx``, counting from 0 at the top of each page."""
    w = W.partitionBy("doc_id", "page").orderBy("line_y")
    return lines.withColumn("line_idx", F.row_number().over(w) - 1)


def merge_spans(words: DataFrame, gap: float = 1.0) -> DataFrame:
    """Join word fragments of one line whose horizontal gap is at most ``gap``.

    Takes words with ``line_y``; gives one row per merged span.
    """
    line = W.partitionBy("doc_id", "page", "line_y").orderBy("x0", "ord")
    apart = F.coalesce((F.col("x0") - F.lag("x1").over(line) > gap).cast("int"), F.lit(1))
    spans = words.withColumn("_apart", apart).withColumn(
        "span", F.sum("_apart").over(line.rowsBetween(W.unboundedPreceding, 0))
    )
    merged = spans.groupBy("doc_id", "page", "line_y", "span").agg(
        F.min("ord").alias("ord"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.sort_array(F.collect_list(F.struct("x0", "ord", "text"))).alias("_parts"),
        F.count(F.lit(1)).alias("n_parts"),
    )
    return merged.withColumn("text", F.array_join(F.col("_parts.text"), "")).drop("_parts")
