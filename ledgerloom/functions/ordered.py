"""Ordered and keyed work that stays even when one key holds a large part of the rows.

Tools, from cheap to general:

* ``with_previous``  - look one row back. Positions are cut into blocks; the first row of a block takes the
  last one of the nearest earlier block from a table with one row per block.
* ``running_total``  - running sums over positions: local sums per block plus the
  total of the earlier blocks. Keys that fit one block need no second step.
* ``split_by_size`` / ``prefix_scan`` - when positions do not exist yet: keys above a size
  limit go a separate way, ordered through several levels so that no task sees a whole key.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 65_536
# A key is "large" when it has more rows than this: what one task may order. It does not grow with the data.
SMALLEST_LARGE = 200_000
SHARE = 0.0
# Longest list of large keys that is fetched and broadcast; a longer one is joined by hash.
BROADCAST_KEYS = 10_000
# Rows of ordinary keys that meet in one task on average. It does not grow with the data either.
TASK_ROWS = 1_000_000


class Split(NamedTuple):
    """Rows of ordinary keys; rows of large keys and the (broadcastable) list of these keys, or None."""

    ordinary: DataFrame
    large: DataFrame | None
    keys: DataFrame | None


def many(df: DataFrame, rows: int) -> int | None:
    """Partitions in which one task gets about ``TASK_ROWS`` of ``rows``; None where the cluster has tasks enough."""
    n = math.ceil(rows / TASK_ROWS)
    return n if n > df.sparkSession.sparkContext.defaultParallelism else None


def hashed(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` hashed on ``keys`` into so many partitions that one task gets about ``TASK_ROWS`` of its ``rows``.

    What tasks order and build then needs the same memory at any size. Few rows are left to adaptive execution."""
    n = many(df, rows)
    return df.repartition(n, *keys) if n else df.repartition(*keys)


def split_by_size(
    df: DataFrame, key: str, share: float = SHARE, floor: int = SMALLEST_LARGE,
    sizes: DataFrame | None = None, hash_ordinary: bool = False,
) -> Split:
    """Divide ``df`` by the size of its keys; both parts together are exactly ``df``.

    A key is large above ``max(floor, share * all rows)``; the default is a fixed number of rows. One sizing job
    runs when the plan is built: a count per key that reads only the key column and is combined before its
    shuffle, or the ready counts in ``sizes`` (key, n). Without large keys, the usual case, the plan has
    a single branch. A short list of large keys is broadcast, a long one joined by hash. ``hash_ordinary``: the ordinary part
    is :func:`hashed` on the key, which the counts pay for.
    """
    if sizes is None:
        sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(key).isNotNull()
    rows, most = sizes.agg(F.sum("n"), F.max(F.when(known, F.col("n")))).first()
    limit = max(floor, share * (rows or 0))
    usual = (lambda part: hashed(part, rows or 0, key)) if hash_ordinary else (lambda part: part)
    if (most or 0) <= limit:
        return Split(usual(df), None, None)
    found = sizes.filter(known & (F.col("n") > F.lit(limit))).select(key)
    few = found.limit(BROADCAST_KEYS + 1).collect()
    keys = F.broadcast(df.sparkSession.createDataFrame(few, found.schema)) if len(few) <= BROADCAST_KEYS else found
    # Rows without a key stay on the ordinary side: an anti join keeps them.
    return Split(usual(df.join(keys, key, "left_anti")), df.join(keys, key, "left_semi"), keys)


def block_of(position: str, block: int = BLOCK) -> Column:
    return F.floor((F.col(position) - 1) / F.lit(block)).cast("bigint")


def with_previous(
    df: DataFrame, key: str, position: str, columns: Mapping[str, str], block: int = BLOCK
) -> DataFrame:
    """Add ``columns`` (new name -> existing column) taken from the row at the next lower position.

    Positions may have gaps. A block of positions never has more than ``block`` rows; the first row of a block
    looks at the last row of the nearest earlier block that has any, found over one row per block.
    """
    w = W.partitionBy(key, "_block").orderBy(position)
    base = df.withColumn("_block", block_of(position, block))
    last = base.groupBy(key, "_block").agg(F.max_by(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), position).alias("_last"))
    before = last.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), F.lag("_last").over(W.partitionBy(key).orderBy("_block")).alias("_carried"))
    out = base.select("*", F.row_number().over(w).alias("_n"), *[F.lag(c).over(w).alias(n) for n, c in columns.items()])
    out = out.join(before, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_at")), "left")
    return out.select(
        *df.columns, *[F.when(F.col("_n") == 1, F.col(f"_carried.{n}")).otherwise(F.col(n)).alias(n) for n in columns]
    )


def running_total(
    df: DataFrame, key: str, position: str, values: Mapping[str, Column], block: int = BLOCK
) -> DataFrame:
    """Add running sums (new name -> expression) in ``position`` order within ``key``."""
    local = W.partitionBy(key, "_block").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    base = df.withColumn("_block", block_of(position, block))
    totals = base.groupBy(key, "_block").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in values.items()])
    offsets = totals.select(
        F.col(key).alias("_key"), F.col("_block").alias("_at"), *[F.sum(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in values]
    ).filter(F.col("_at") > 0)
    out = base.select("*", *[F.sum(e).over(local).alias(n) for n, e in values.items()])
    # Null-safe, so rows without a key are one key whatever the size of a block.
    out = out.join(offsets, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_at")), "left")
    for n in values:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)))
    return out.drop("_block", "_key", "_at", *[f"_o_{n}" for n in values])


def prefix_scan(
    df: DataFrame, key: str, levels: Sequence[str], values: Mapping[str, Column]
) -> DataFrame:
    """Inclusive running sums for large keys, ordered by ``levels`` from coarse to fine.

    Every level but the last is a bucket of what follows it (date, bucket of numbers, number).
    Sums of whole buckets are far fewer than rows; they are ranked level by level, and only the
    finest bucket is ordered row by row. No task orders a key as a whole.
    """
    *coarse, finest = levels
    sums = {n: f"_s_{n}" for n in values}
    totals = df.groupBy(key, *coarse).agg(*[F.sum(e).alias(sums[n]) for n, e in values.items()])
    # offsets[k]: for each bucket of depth k, the total of everything before it.
    offsets = None
    for depth in range(1, len(coarse) + 1):
        outer, own = list(coarse[: depth - 1]), coarse[depth - 1]
        here = totals.groupBy(key, *outer, own).agg(*[F.sum(s).alias(s) for s in sums.values()])
        before = W.partitionBy(key, *outer).orderBy(own).rowsBetween(W.unboundedPreceding, -1)
        here = here.select(
            key, *outer, own,
            *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_h{s}") for s in sums.values()],
        )
        if offsets is None:
            offsets = here.select(
                key, own, *[F.col(f"_h{s}").alias(f"_o{s}") for s in sums.values()]
            )
        else:
            parent = offsets.select(
                *[F.col(c).alias(f"_k_{c}") for c in (key, *outer)], *[f"_o{s}" for s in sums.values()]
            )
            match = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (key, *outer)]
            offsets = here.join(parent, reduce(and_, match)).select(
                key, *outer, own,
                *[(F.col(f"_h{s}") + F.col(f"_o{s}")).alias(f"_o{s}") for s in sums.values()],
            )
    local = W.partitionBy(key, *coarse).orderBy(finest).rowsBetween(W.unboundedPreceding, 0)
    out = df.select("*", *[F.sum(e).over(local).alias(n) for n, e in values.items()])
    # Null-safe, so rows with an empty bucket keep their place like any other.
    renamed = offsets.select(
        *[F.col(c).alias(f"_k_{c}") for c in (key, *coarse)], *[f"_o{s}" for s in sums.values()]
    )
    match = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (key, *coarse)]
    out = out.join(renamed, reduce(and_, match))
    for n, s in sums.items():
        out = out.withColumn(n, F.col(n) + F.col(f"_o{s}"))
    return out.drop(*[f"_k_{c}" for c in (key, *coarse)], *[f"_o{s}" for s in sums.values()])
