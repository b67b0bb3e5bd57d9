"""Known layouts: learned from documents, matched within a tolerance, pooled into column edges.

A layout is a vector of column edges. Two vectors are one layout when no edge is more than ``TOLERANCE`` apart, wherever
the edges lie: vectors are kept in cells of twice the tolerance, a template stands in every cell that its tolerance
reaches (at most two per edge), a vector looks into its own cell, and the true distance decides. So documents are
never copied, and a match is one equi-join of different vectors per size of cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..sources.scratch import stored
from .layout import cluster_cells

EDGES = ("withdrawal_x", "deposit_x", "amount_x", "balance_x")
TOLERANCE = 5.0
#: Documents that a learned layout needs, amounts that an edge of a pooled layout needs.
MIN_DOCUMENTS, MIN_AMOUNTS = 2, 2
#: Different templates that a cell may hold at ease; each step of finer cells divides them by so much; most steps.
FEW, FINER, MAX_STEPS = 64, 8, 4


def _cell(x: Column, tolerance: float) -> Column:
    return F.floor(x / F.lit(2 * tolerance)).cast("string")


def _key(n: Column, cells: list[Column]) -> Column:
    return F.concat_ws("|", n.cast("string"), *[F.coalesce(c, F.lit("-")) for c in cells])


def _home(tolerance: float) -> Column:
    return _key(F.col("n_clusters"), [_cell(F.col(c), tolerance) for c in EDGES])


def _reach(templates: DataFrame, tolerance: float) -> DataFrame:
    """``templates`` once for each cell that their tolerance reaches, with ``_key``."""
    out = templates
    for c in EDGES:
        low, high = (_cell(F.col(c) + F.lit(d), tolerance) for d in (-tolerance, tolerance))
        out = out.withColumn(f"_at_{c}", F.explode(F.array_distinct(F.array(F.coalesce(low, F.lit("-")), F.coalesce(high, F.lit("-"))))))
    return out.withColumn("_key", _key(F.col("n_clusters"), [F.col(f"_at_{c}") for c in EDGES])).drop(*[f"_at_{c}" for c in EDGES])


def _apart(other) -> Column:
    """The largest distance of two vectors' edges, to a millionth of a point; both have the same edges."""
    return F.round(F.greatest(*[F.coalesce(F.abs(F.col(c) - other(c)), F.lit(0.0)) for c in EDGES]), 6)


def _nearest(vectors: DataFrame, templates: DataFrame, tolerance: float) -> DataFrame:
    """``vectors`` with ``_best``, the least (distance, template) within ``tolerance`` or null. The templates of a cell are one row."""
    cells = _reach(templates, tolerance).groupBy("_key").agg(F.collect_set(F.struct("template", *EDGES)).alias("_near"))
    found = vectors.withColumn("_key", _home(tolerance)).join(cells, "_key", "left")
    ranked = F.transform("_near", lambda t: F.struct(_apart(lambda c: t[c]).alias("distance"), t["template"].alias("template")))
    best = F.array_min(F.filter(ranked, lambda r: r["distance"] <= tolerance))
    return found.select(*vectors.columns, best.alias("_best"))


def match(bounds: DataFrame, templates: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``bounds`` with ``template`` and ``distance``: the nearest template within ``tolerance``, of equally near ones the
    smallest; null without one.

    ``templates``: template, n_clusters and the edges. Equal vectors are looked up once and equal templates are one, so copies of a
    layout cost nothing. With more than ``FEW`` different templates, cells are fine at first: what has a template within a fine
    tolerance is settled there, as all nearer ones reach the same cell, and only the rest looks around wider. ``bounds`` is read twice."""
    vector = ("n_clusters", *EDGES)
    known = templates.groupBy(*vector).agg(F.min(F.struct("template"))["template"].alias("template"))
    known = stored(known, "known-vectors")
    n, steps = known.count(), 0
    while n > FEW * FINER**steps and steps < MAX_STEPS:
        steps += 1
    left, settled = bounds.select(*vector).distinct(), None
    for step in range(steps, 0, -1):
        fine = tolerance / FINER**step
        # Distances are rounded: those that might as well be a little above the fine tolerance stay open.
        sure = F.coalesce(F.col("_best.distance") <= fine - 1e-6, F.lit(False))
        tried = stored(_nearest(left, known, fine).withColumn("_sure", sure), "tried-vectors")
        done = tried.filter("_sure").drop("_sure")
        settled = done if settled is None else settled.unionByName(done)
        left = tried.filter("not _sure").select(*vector)
    rest = _nearest(left, known, tolerance)
    found = rest if settled is None else settled.unionByName(rest)
    found = found.filter("_best is not null").select("_best", *[F.col(c).alias(f"_v_{c}") for c in vector])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_v_{c}")) for c in vector])
    return bounds.join(found, same, "left").select(*bounds.columns, F.col("_best.template").alias("template"), F.col("_best.distance").alias("distance"))


def learn(bounds: DataFrame, tolerance: float = TOLERANCE, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """template, n_clusters, edges, n_docs: the layouts that several documents show.

    Documents are averaged per cell. Of averages within the tolerance of each other the one with most documents (then the smallest
    name) stays, in rounds: one with no better one around is a layout, those around a layout go, and so on. Rounds work on
    averages only, and each is stored."""
    means = bounds.groupBy(_home(tolerance).alias("template")).agg(
        F.first("n_clusters").alias("n_clusters"), *[F.avg(c).alias(c) for c in EDGES], F.count(F.lit(1)).alias("n_docs")
    )
    means = stored(means.filter(F.col("n_docs") >= min_documents), "layout-means")
    own = means.withColumn("_key", _home(tolerance)).select("_key", *[F.col(c).alias(f"o_{c}") for c in EDGES], F.col("template").alias("other"), F.col("n_docs").alias("o_docs"))
    near = _reach(means, tolerance).join(own, "_key").filter((F.col("template") != F.col("other")) & (_apart(lambda c: F.col(f"o_{c}")) <= tolerance))
    better = (F.col("o_docs") > F.col("n_docs")) | (F.col("o_docs") == F.col("n_docs")) & (F.col("other") < F.col("template"))
    near = stored(near.select("template", "other", better.alias("better")).distinct(), "layout-neighbours")
    open_, chosen = means.select("template"), None
    while True:
        # Around means both ways: a mean may reach the other's cell, and the distance is the same from either side.
        among = near.join(open_, "template", "left_semi").join(open_.withColumnRenamed("template", "other"), "other", "left_semi")
        leads = stored(open_.join(among.filter("better").select("template"), "template", "left_anti"), "layouts")
        if leads.isEmpty():
            break
        chosen = leads if chosen is None else chosen.unionByName(leads)
        around = among.join(leads.withColumnRenamed("template", "other"), "other", "left_semi").select("template")
        open_ = stored(open_.join(leads, "template", "left_anti").join(around, "template", "left_anti"), "open-layouts")
    return means if chosen is None else means.join(chosen, "template", "left_semi")


def adopt(clusters: DataFrame, templates: DataFrame, tolerance: float = TOLERANCE, margin: float = S.BOUND_MARGIN) -> DataFrame:
    """doc_id, template of documents that show only some columns of a layout.

    ``clusters``: doc_id, cluster, mean_x of documents. A template is adopted if every cluster stands at one of its edges; of several
    the one with most documents, then the nearest, then the smallest name."""
    spots = F.array_compact(F.array(*EDGES))
    columns = templates.select("template", "n_docs", F.explode(spots).alias("edge"))
    cell = lambda c, d=0.0: F.floor((F.col(c) + F.lit(d)) / F.lit(2 * tolerance))
    columns = columns.withColumn("_cell", F.explode(F.array_distinct(F.array(cell("edge", -tolerance), cell("edge", tolerance)))))
    n = clusters.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    at = clusters.withColumn("_x", F.col("mean_x") - margin).withColumn("_cell", cell("_x"))
    off = F.abs(F.col("_x") - F.col("edge"))
    hits = at.join(columns, "_cell").filter(off <= tolerance).groupBy("doc_id", "template").agg(
        F.count_distinct("cluster").alias("_hit"), F.max("n_docs").alias("n_docs"), F.sum(off).alias("_off")
    )
    full = hits.join(n, "doc_id").filter(F.col("_hit") == F.col("_n"))
    return full.groupBy("doc_id").agg(F.min(F.struct(-F.col("n_docs"), "_off", "template"))["template"].alias("template"))


def pooled(cells: DataFrame, labels: DataFrame, gap: float = S.CLUSTER_GAP, margin: float = S.BOUND_MARGIN, min_amounts: int = MIN_AMOUNTS) -> DataFrame:
    """template, withdrawal_x, deposit_x, balance_x, n_withdrawal, n_deposit, n_balance: edges from the positions of all amounts
    of a template's documents, with the amounts that support each.

    ``cells``: ``layout.position_cells`` (amounts); ``labels``: doc_id, template. A template's histogram of cells adds up from its
    documents' in any order, so one of very many documents combines before its exchange."""
    of = cells.filter(F.col("role") == "amount").join(labels.select("doc_id", "template"), "doc_id")
    summed = of.groupBy("template", "cell").agg(F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.sum("sum_x").alias("sum_x"), F.sum("n").alias("n"))
    at = cluster_cells(summed, "template", gap=gap)
    inside = lambda i, c: F.sum(F.when(F.col("cluster") == i, F.col(c)))
    names = {1: "withdrawal", 2: "deposit", 3: "balance"}
    wide = at.groupBy("template").agg(
        F.max("cluster").alias("_n"), *[(inside(i, "sum_x") / inside(i, "n") - margin).alias(f"{c}_x") for i, c in names.items()],
        *[inside(i, "n").alias(f"n_{c}") for i, c in names.items()],
    )
    enough = reduce(lambda a, b: a & b, [F.col(f"n_{c}") >= min_amounts for c in names.values()])
    return wide.filter((F.col("_n") >= 3) & enough).drop("_n")


def profiles(bounds: DataFrame, labels: DataFrame, pools: DataFrame) -> DataFrame:
    """doc_id, withdrawal_x, deposit_x, balance_x, source: the column profile of each document for ``geometry.type_words``.

    A document's own edges where it shows all three columns, else those of its template; documents with neither are not listed and get
    the default profile. ``labels`` and ``bounds`` have at most one row per document."""
    own = bounds.filter(F.col("n_clusters") >= 3).select("doc_id", "withdrawal_x", "deposit_x", "balance_x")
    known = labels.join(pools.select("template", "withdrawal_x", "deposit_x", "balance_x"), "template").drop("template")
    rest = known.join(own.select("doc_id"), "doc_id", "left_anti")
    return own.withColumn("source", F.lit("document")).unionByName(rest.select(*own.columns, F.lit("template").alias("source")))


def learned_profiles(roles: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """:func:`profiles` from nothing but the words' roles: layouts are learned, matched and adopted, then pooled."""
    from .layout import bounds_of, cluster_stats, position_cells

    cells = stored(position_cells(roles), "position-cells")
    bounds = stored(bounds_of(cells), "bounds")
    full = bounds.filter(F.col("n_clusters") >= 3)
    known = stored(learn(full, tolerance), "known-layouts")
    matched = match(full, known, tolerance).filter(F.col("template").isNotNull()).select("doc_id", "template")
    partial = cluster_cells(cells.filter(F.col("role") == "amount"), "doc_id").join(full.select("doc_id"), "doc_id", "left_anti")
    labels = stored(matched.unionByName(adopt(cluster_stats(partial), known, tolerance)), "layout-labels")
    return profiles(bounds, labels, pooled(cells, labels))
