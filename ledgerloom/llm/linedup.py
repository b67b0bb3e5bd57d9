"""Line deduplication by a deletion-neighbourhood join.

A line (cut at line ends, ASCII blanks taken off both ends) that holds a word goes if the same line occurs earlier: in a
document with a smaller doc_id, or further up in the same document. A line of at least ``NEAR_CHARS`` characters goes as well
if a line of that length within one edit of it (a character put in, taken out or replaced) occurs earlier; one edit of a shorter line
often makes another word of it. The earlier line may be one that goes itself; what is named as kept is the line at the end of
such a chain, which stays.

1. Lines are split and hashed once and stored without their texts. Equal lines become one class with its first occurrence
   (combined before the exchange).
2. One edit leaves the first or the last half of a line untouched, so every line gives the hashes of its halves,
   tagged with the length that it may share: four short keys. Only lines that share a key with another line go on, and
   only their documents are read again.
3. Of these, lines that share all but one of ``FINE`` parts with another differ within that part only, so their
   deletion neighbourhoods are those of that part: parts that lose the character at the same place and become equal differ
   by a replacement; a part equal to another without one character differs by an insertion. In each such group all are within the bound
   of the one they are compared with, so the earliest of a group is enough and no pairs are spelled out.
4. The edit distance to that earliest line is verified on the texts.

Rows are looked up by keys of which at most 2^``BITS`` short values are sent to all tasks first, so most rows that cannot meet
anything never enter an exchange; the exact join follows. The plan is the same at every size.

Defined results: null texts have no lines; lines without a word stay; rows without doc_id come after all others and
each is a document of its own; rows with the same doc_id and text stay or go together, different texts under one doc_id lose their
own lines only; an empty table gives an empty result. Document columns are kept by :func:`cleaned` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .names import free

#: Characters that a line needs to go for a line within one edit of it. Equal lines go at any length.
NEAR_CHARS = 20
BLANKS = " \t\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]"
FINE, BITS = 16, 20
PLACE = ("doc", "row", "no")


def identified(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns that tell rows apart, and the names of these: (is null, doc_id), and the hash of the text, or a number
    of the row where doc_id is null. Numbered rows are stored, as they are read again and must keep their numbers."""
    doc, row = free(docs.columns, "doc", "row")
    own = F.col("doc_id").cast("long")
    key = F.struct(own.isNull().alias("nil"), own.alias("id"))
    named = docs.where(own.isNotNull()).withColumns({doc: key, row: F.xxhash64(F.col("text").cast("string"))})
    unnamed = docs.where(own.isNull()).withColumns({doc: key, row: F.monotonically_increasing_id()})
    return named.unionByName(stored(unnamed, "rows-without-id")), [doc, row]


def _split(rows: DataFrame, names: list[str]) -> DataFrame:
    """doc, row, no (from 0), line, k1, k2 of every line that holds a word."""
    doc, row = names
    every = rows.where(F.col("text").isNotNull()).select(F.col(doc).alias("doc"), F.col(row).alias("row"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("no", "raw"))
    every = every.select(*PLACE, F.btrim("raw", F.lit(BLANKS)).alias("line")).where("line <> ''")
    return every.select(*PLACE, "line", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def _tag(*key: str) -> Column:
    return (F.pmod(F.col(key[0]), F.lit(1 << BITS)) if len(key) == 1 else F.pmod(F.xxhash64(*key), F.lit(1 << BITS))).cast("int")


def _among(rows: DataFrame, key: tuple[str, ...], wanted: DataFrame, of: tuple[str, ...] | None = None, how: str = "left_semi") -> DataFrame:
    """Rows whose key may be among those of ``wanted``: at most 2^BITS short values are sent to all tasks."""
    tags = wanted.select(_tag(*(of or key)).alias("_tag")).distinct()
    return rows.join(F.broadcast(tags), _tag(*key) == F.col("_tag"), how)


def _cuts(tag: Column, j: Column, parts: int) -> tuple[Column, Column]:
    """(characters before, characters after) part j of a line, by the longer length of the pair it is for."""
    start, stop = (F.floor((tag - 1) * i / parts).cast("int") for i in (j, j + 1))
    return start, F.when(j < parts - 1, tag - 1 - stop).otherwise(0)


def _intact(line: Column, tag: Column, j: Column, parts: int) -> Column:
    """The hash of a line without its part j, tagged with the longer length of a pair."""
    n = F.length(line)
    start, after = _cuts(tag, j, parts)
    return F.xxhash64(tag, j, line.substr(F.lit(1), start), line.substr(n - after + 1, after))


def _part(line: Column, tag: Column, j: Column, parts: int) -> Column:
    start, after = _cuts(tag, j, parts)
    return line.substr(start + 1, F.length(line) - start - after)


def _halves() -> list[Column]:
    line, n = F.col("line"), F.length("line")
    return [F.when(n >= NEAR_CHARS, _intact(line, n + d, F.lit(j), 2)).alias(f"h{2 * d + j}") for d in (0, 1) for j in (0, 1)]


def _shared(each: DataFrame, name: str) -> DataFrame:
    """Keys that different lines have in common."""
    return stored(each.groupBy("key").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi").select("key"), name)


def _near(rows: DataFrame, names: list[str], classes: DataFrame) -> DataFrame:
    """k1, k2, o1, o2, kept: classes within one edit of an earlier one, which is named by its hashes and place."""
    halves = F.array(*[F.col(f"h{i}") for i in range(4)])
    each = classes.where("h0 IS NOT NULL").select("k1", "k2", F.explode(halves).alias("key"))
    shared = _shared(each, "shared-halves")
    chosen = stored(_among(each, ("key",), shared).join(shared, "key", "left_semi").select("k1", "k2").distinct(), "near-classes")
    chosen = stored(_among(classes.select("k1", "k2", "first"), ("k1",), chosen).join(chosen, ["k1", "k2"], "left_semi").select("k1", "k2", "first.*"), "near-places")
    # Only documents that hold a candidate's first occurrence are split again.
    holding = _among(rows, tuple(names), chosen, ("doc", "row"))
    again = _among(_split(holding, names), ("k1",), chosen)
    texts = again.join(chosen, [*PLACE, "k1", "k2"]).groupBy("k1", "k2").agg(F.first("line").alias("line"), F.min(F.struct(*PLACE)).alias("first"))
    texts = stored(texts, "candidate-lines")

    line, n = F.col("line"), F.length("line")

    def spelt(x: Column) -> Column:
        j, d = F.pmod(x, F.lit(FINE)), F.floor(x / FINE).cast("int")
        return F.struct(_intact(line, n + d, j, FINE).alias("key"), d.alias("shorter"), _part(line, n + d, j, FINE).alias("part"))

    parts = stored(texts.select("k1", "k2", "first", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2 * FINE - 1)), spelt)).alias("s")).select("k1", "k2", "first", "s.*"), "line-parts")
    open_ = _among(parts, ("key",), shared := _shared(parts, "shared-parts")).join(shared, "key", "left_semi")

    def without(i: Column) -> Column:
        return F.concat(F.substring("part", F.lit(1), i), F.substring("part", i + 2, F.length("part")))

    def variant(role: str, kind: str, *of: Column) -> Column:
        return F.struct(F.xxhash64(F.lit(kind), "key", *of).alias("variant"), F.lit(role).alias("role"))

    places = F.filter(F.sequence(F.lit(0), F.length("part")), lambda i: i < F.length("part"))
    longer = F.concat(F.transform(places, lambda i: variant("r", "replace", i, without(i))), F.transform(places, lambda i: variant("d", "insert", without(i))))
    shorter = F.array(variant("w", "insert", F.col("part")))
    hood = open_.select("k1", "k2", "first", F.explode(F.when(F.col("shorter") == 0, longer).otherwise(shorter)).alias("v")).select("k1", "k2", "first", "v.*")
    hood = stored(hood, "neighbourhood")
    groups = hood.groupBy("variant").agg(
        *[F.min(F.when(F.col("role") == r, F.struct("first", "k1", "k2"))).alias(r) for r in "rdw"],
        F.count("*").alias("n"),
    ).where("n > 1")
    met = hood.join(stored(groups, "meeting-keys"), "variant")
    # A replaced character: the earliest of the group. An inserted one: the shorter line looks at the earliest longer
    # one, a longer line at the shorter one.
    other = F.when(F.col("role") == "r", F.col("r")).when(F.col("role") == "w", F.col("d")).otherwise(F.col("w"))
    found = met.select("k1", "k2", "first", other.alias("o")).where(F.col("o").isNotNull() & (F.col("o.first") < F.col("first")))
    found = found.select("k1", "k2", F.col("o.k1").alias("o1"), F.col("o.k2").alias("o2"), F.col("o.first").alias("kept")).distinct()
    return (
        found.join(texts.select("k1", "k2", F.col("line").alias("mine")), ["k1", "k2"])
        .join(texts.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("line").alias("theirs")), ["o1", "o2"])
        .where(F.levenshtein("mine", "theirs", 1).between(0, 1))
        .groupBy("k1", "k2").agg(F.min(F.struct("kept", "o1", "o2")).alias("o")).select("k1", "k2", "o.*")
    )


def _survivors(near: DataFrame) -> DataFrame:
    """``near`` with the line at the end of each chain of nearly equal lines. Every round doubles the steps taken."""
    at = stored(near, "near-lines")
    while True:
        further = at.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("kept").alias("kept_2"), F.col("o1").alias("p1"), F.col("o2").alias("p2"))
        joined = at.join(further, ["o1", "o2"], "left")
        moved = F.col("p1").isNotNull()
        step = [F.when(moved, F.col(new)).otherwise(F.col(old)).alias(old) for new, old in (("kept_2", "kept"), ("p1", "o1"), ("p2", "o2"))]
        at = stored(joined.select("k1", "k2", *step, moved.alias("moved")), "near-lines")
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")


def _gone(rows: DataFrame, names: list[str]) -> DataFrame:
    """doc, row, no, kept (place), near of every line occurrence that goes."""
    every = stored(_split(rows, names).select(*PLACE, "k1", "k2", *_halves()), "lines")
    halves = [F.min(f"h{i}").alias(f"h{i}") for i in range(4)]
    classes = stored(every.groupBy("k1", "k2").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n"), *halves), "line-classes")
    close = stored(_survivors(_near(rows, names, classes)).select("k1", "k2", "kept"), "survivors")
    repeated = classes.where("n > 1").select("k1", "k2", "first").join(close.select("k1", "k2"), ["k1", "k2"], "left_anti")
    nothing = F.lit(False)
    marked = repeated.select("k1", "k2", F.col("first").alias("kept"), nothing.alias("near")).unionByName(close.select("k1", "k2", "kept", (~nothing).alias("near")))
    marked = stored(marked, "marked-lines")
    met = _among(every.select(*PLACE, "k1", "k2"), ("k1",), marked).join(marked, ["k1", "k2"])
    return met.where(F.col("near") | (F.struct(*PLACE) != F.col("kept"))).select(*PLACE, "kept", "near")


def removed(docs: DataFrame) -> DataFrame:
    """doc, no, kept_doc, kept_no, near: every line occurrence that goes, with the line that stays for it.

    ``near`` tells an edit from an equal line."""
    gone = _gone(*identified(docs.select("doc_id", "text")))
    return gone.select(F.col("doc.id").alias("doc"), "no", F.col("kept.doc.id").alias("kept_doc"), F.col("kept.no").alias("kept_no"), "near")


def _words(text: Column) -> Column:
    """Characters in words."""
    return F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))


def cleaned(docs: DataFrame, copied: float = 1.0) -> DataFrame:
    """``docs`` with all columns, repeated lines taken out of ``text`` and ``n_chars`` to match. Documents that lose lines
    and keep no word go, and so do those that lose at least ``copied`` of their words (counted in characters): these are copies of
    earlier text, of which only the places that differ would stay."""
    rows, names = identified(docs)
    per_row = stored(_gone(rows, names).groupBy("doc", "row").agg(F.collect_set("no").alias("gone")), "removed-lines")
    whole = _among(rows, tuple(names), per_row, ("doc", "row"), "left_anti").select(*docs.columns)
    doc, row, gone, text = free(rows.columns, "own_doc", "own_row", "gone", "kept_text")
    hit = _among(rows, tuple(names), per_row, ("doc", "row"))
    losses = per_row.select(F.col("doc").alias(doc), F.col("row").alias(row), F.col("gone").alias(gone))
    joined = hit.join(losses, (F.col(names[0]) == F.col(doc)) & (F.col(names[1]) == F.col(row)), "left")
    old = F.col("text").cast("string")
    lines = F.split(old, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    new = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    loses = F.col(gone).isNotNull()
    held = joined.withColumn(text, F.when(loses, new).otherwise(old))
    held = held.where(~loses | (F.col(text).rlike(WORD) & (_words(F.col(text)) > F.round(_words(old) * F.lit(1.0 - copied), 6))))
    changed = {"text": F.when(loses, F.col(text)).otherwise(F.col("text")) if dict(docs.dtypes)["text"] == "string" else F.col(text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(loses, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return whole.unionByName(held.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]))
