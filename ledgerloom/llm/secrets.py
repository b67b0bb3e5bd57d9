"""Secret scans over a ledger of content-addressed blobs.

Every historical version of every path is addressed by the SHA-256 of its content. A ledger records which
(blob, rule version) pairs have been scanned and what was found; a scan touches only pairs that the ledger does
not hold, each blob once however many paths carry it, and joins the findings back to all paths.

Defined results: null content is empty content; repeated rows each get their findings; a path or any other column
may be null; a text may hold any number of findings; an empty table gives an empty result. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored

SPAN = "array<struct<start:int,rank:int,kind:string,stop:int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; of these stay those whose ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds in their listed order. Runs below the least length are left out by the pattern
# where that gives the same matches, by ``least`` where a failing match still uses up its text.
BASE = (
    Rule(
        "assign", 1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
)
#: Further rules of this library, after the base ones.
MORE = (
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


def _with(value: Column, use) -> Column:
    """``use(value)``, the value computed once however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(steps: Column, rule: Rule, rank: int) -> Column:
    """Spans of (gap, hit, good) in order. Steps are folded in blocks as long as there are blocks, and each block is then moved by
    the length of those before it, so that work grows with n to the power of 1.5 and not with the square that one fold
    over a growing array takes."""
    n = F.size(steps)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        stop = start + x["hit"]
        one = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(x["good"], F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    def block(first: Column) -> Column:
        return F.aggregate(F.slice(steps, first + 1, width), F.struct(F.lit(0).alias("at"), none.alias("found")), step)

    def starts(blocks: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        return F.aggregate(
            blocks, begin, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
            lambda acc: acc["starts"],
        )

    def moved(blocks: Column, before: Column) -> Column:
        return F.flatten(F.transform(blocks, lambda b, k: F.transform(b["found"], lambda x: F.struct(
            (x["start"] + F.get(before, k)).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (x["stop"] + F.get(before, k)).alias("stop"),
        ))))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), width), block)
    return _with(blocks, lambda found: _with(starts(found), lambda before: moved(found, before)))


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Matches with positions: the text between matches comes from ``split`` with the same pattern, so the start of
    a match is the length of all gaps and matches before it."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.arrays_zip(
        hits.alias("hit"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("value"),
        F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits)).alias("gap"),
    )
    steps = F.transform(parts, lambda x: F.struct(
        F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), (F.length(x["value"]) >= rule.least).alias("good"),
    ))
    found = _with(steps, lambda x: _placed(x, rule, rank))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array()).cast(SPAN)


def blobs_of(versions: DataFrame, content: str) -> DataFrame:
    """blob, content: each different content once. Copies on one task meet before the exchange."""
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    return versions.select(F.sha2(text, 256).alias("blob"), text.alias("content")).groupBy("blob").agg(F.first("content").alias("content"))


def scan(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, rules, spans) for the pairs of blob and rule version that ``ledger`` lacks."""
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("todo", every)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = (
            blobs.join(seen, "blob", "left")
            .select("blob", "content", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
            .where(F.size("todo") > 0)
        )
    none = F.array().cast(SPAN)
    found = [
        F.when(F.array_contains("todo", r.key), spans(F.col("content"), r, i)).otherwise(none) if ledger is not None else spans(F.col("content"), r, i)
        for i, r in enumerate(rules)
    ]
    return todo.select("blob", F.col("todo").alias("rules"), F.concat(*found).alias("spans"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(f"blob string, rules array<string>, spans {SPAN}"))


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The ledger stored at ``path``; an empty one is written where there is none."""
    empty = empty_ledger(spark)
    empty.write.mode("ignore").parquet(path)
    return spark.read.schema(empty.schema).parquet(path)


def deliver(path: str, versions: DataFrame, content: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Take a delivery of versions into the ledger stored at ``path`` and return the ledger after it.

    Only pairs of blob and rule version that the ledger lacks are scanned and appended, in one commit: a delivery that failed adds
    nothing and may be repeated, one that went through adds nothing when it comes again. One writer at a time."""
    spark = versions.sparkSession
    scan(blobs_of(versions, content), opened(spark, path), rules).write.mode("append").parquet(path)
    return opened(spark, path)


def findings(versions: DataFrame, content: str, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of ``versions`` without its content, with ``blob`` and ``spans`` (by start, then rule) from the ledger.

    Rules that are no longer in ``rules`` or were scanned in another version are left out."""
    current = reduce(or_, [(F.col("span.kind") == r.kind) & F.array_contains("rules", r.key) for r in rules])
    known = ledger.select("blob", "rules", F.explode("spans").alias("span")).where(current)
    # Written first, so that the join below has two plain inputs and adaptive execution can split a blob that
    # a large part of all paths share.
    per_blob = stored(known.groupBy("blob").agg(F.array_sort(F.collect_set("span")).alias("spans")), "findings")
    paths = versions.select(
        *[versions[c] for c in versions.columns if c not in (content, "blob", "spans")],
        F.sha2(F.coalesce(versions[content].cast("string"), F.lit("")), 256).alias("blob"),
    )
    return paths.join(per_blob, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
