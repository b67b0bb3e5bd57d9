"""Continuous intake: pages of words arrive as files, ledgers are kept current per document.

A page is the unit of delivery; a document may come in any number of batches. The newest delivery of a page counts, a page
delivered again with equal content is skipped, and a document is read again from all its pages when one of them is new. With
a list of expected page counts, a document is read once it is complete and waits until then.

What has been delivered is kept as one short row per page, in hash buckets of documents (``BUCKETS``). A batch looks only
into the buckets it touches: the last compacted state, and the batches since, at most ``COMPACT_EVERY``. Words of earlier
batches are read only where a touched document has pages there. The store is append-only: each batch writes its own folders,
a repeated batch overwrites exactly those and never sees what it wrote before.

    pages/batch=N/bucket=B       doc_id, page, content, n: pages taken in by a batch
    state/upto=N/bucket=B        the same with batch, newest of each page up to a batch
    words/batch=N/bucket=B       their words
    ledger/batch=N               rows of the documents read in a batch
    deliveries/batch=N           doc_id, n_pages, n: these documents, written last

Words without document, page, position or text have no place in a page and are left out, as everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators import guard
from ..plans import statement
from ..sources.scratch import stored

BUCKETS, COMPACT_EVERY = 32, 16


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("bucket")


def content_marks(words: DataFrame) -> DataFrame:
    """doc_id, page, content (a hash that no order of the words changes), n; combined before the shuffle."""
    mark = F.xxhash64("page", "ord", "x0", "y0", "text")
    return words.groupBy("doc_id", "page").agg(
        F.concat_ws(
            "-", F.hex(F.bit_xor(mark)), F.sum(mark.cast("decimal(20,0)")).cast("string"),
            F.count(F.lit(1)).cast("string"),
        ).alias("content"),
        F.count(F.lit(1)).alias("n"),
    )


def _fields(doc_type: T.DataType, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("doc_id", doc_type), *[T.StructField(n, t) for n, t in more]])


def _pages_schema(doc_type: T.DataType, batch: bool = True) -> T.StructType:
    own = [("page", T.IntegerType()), ("content", T.StringType()), ("n", T.LongType())]
    return _fields(doc_type, *own, *[("batch", T.LongType())] * batch, ("bucket", T.IntegerType()))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there; asks the file system, not the data."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath))


def _numbers(spark: SparkSession, path: str, key: str) -> list[int]:
    """N of the finished folders ``key=N`` under a path."""
    if not _exists(spark, path):
        return []
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in jpath.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jpath)]
    own = [int(n.split("=")[1]) for n in names if n.startswith(f"{key}=")]
    return sorted(n for n in own if _exists(spark, f"{path}/{key}={n}/_SUCCESS"))


def pages_before(spark: SparkSession, store: str, doc_type: T.DataType, batch: int, buckets: list[int] | None = None) -> DataFrame:
    """doc_id, page, content, n, batch, bucket: the newest delivery of each page before a batch, of the given buckets."""
    schema = _pages_schema(doc_type)
    state = max((n for n in _numbers(spark, f"{store}/state", "upto") if n < batch), default=-1)
    later = [n for n in _numbers(spark, f"{store}/pages", "batch") if state < n < batch]
    # Without rows and without a task that would start Python to make none.
    found = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    if state >= 0:
        kept = spark.read.schema(schema).option("basePath", f"{store}/state/upto={state}").parquet(f"{store}/state/upto={state}")
        found = kept
    if later:
        new = spark.read.schema(schema).option("basePath", f"{store}/pages").parquet(*[f"{store}/pages/batch={n}" for n in later])
        found = new if state < 0 else found.unionByName(new)
    if buckets is not None:
        found = found.filter(F.col("bucket").isin(buckets))
    newest = F.max_by(F.struct("content", "n", "batch", "bucket"), "batch").alias("p")
    return found.groupBy("doc_id", "page").agg(newest).select("doc_id", "page", "p.*")


def _compacted(spark: SparkSession, store: str, doc_type: T.DataType, batch: int) -> None:
    """Write the state up to a batch once enough batches have come since the last one."""
    state = max((n for n in _numbers(spark, f"{store}/state", "upto") if n < batch), default=-1)
    if len([n for n in _numbers(spark, f"{store}/pages", "batch") if state < n <= batch]) < COMPACT_EVERY:
        return
    newest = pages_before(spark, store, doc_type, batch + 1)
    newest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/state/upto={batch}")


def deliveries(spark: SparkSession, store: str, doc_type: T.DataType) -> DataFrame:
    """doc_id, n_pages, n, batch: every time a document was read."""
    schema = _fields(doc_type, ("n_pages", T.LongType()), ("n", T.LongType()), ("batch", T.LongType()))
    if not _exists(spark, f"{store}/deliveries"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{store}/deliveries")


def latest(seen: DataFrame) -> DataFrame:
    """The newest reading of each document."""
    return seen.groupBy("doc_id").agg(F.max("batch").alias("batch"))


def _earlier_words(spark: SparkSession, store: str, doc_type: T.DataType, older: DataFrame) -> DataFrame | None:
    """Words of pages that came in earlier batches, read from the folders that hold them."""
    # At most one short row per batch and bucket.
    where = [(r.batch, r.bucket) for r in older.select("batch", "bucket").distinct().collect()]
    if not where:
        return None
    schema = S.words_schema(doc_type).add("batch", T.LongType()).add("bucket", T.IntegerType())
    folders = [f"{store}/words/batch={n}/bucket={b}" for n, b in sorted(where)]
    words = spark.read.schema(schema).option("basePath", f"{store}/words").parquet(*folders)
    return words.join(older.select("doc_id", "page", "batch"), ["doc_id", "page", "batch"], "left_semi").drop("batch", "bucket")


def take_batch(words: DataFrame, batch: int, store: str, doc_type: T.DataType, expected: DataFrame | None = None, **options) -> None:
    """Take in the pages of one batch that are new or changed and read their documents.

    ``expected``: doc_id, n_pages; documents listed there wait until so many of their pages are there."""
    spark, columns = words.sparkSession, S.words_schema(doc_type).names
    words = words.select(*columns).filter(guard.malformed(words).isNull())
    marks = stored(content_marks(words).withColumn("bucket", _bucket(BUCKETS)), "delivered-pages")
    touched = [r.bucket for r in marks.select("bucket").distinct().collect()]
    before = stored(pages_before(spark, store, doc_type, batch, touched), "pages-before")
    fresh = stored(marks.join(before.select("doc_id", "page", "content"), ["doc_id", "page", "content"], "left_anti"), "fresh-pages")
    # What is left out are pages delivered again unchanged: most often none, and then words need not meet a list of pages.
    same = stored(marks.join(before.select("doc_id", "page", "content"), ["doc_id", "page", "content"], "left_semi").select("doc_id", "page"), "unchanged-pages")
    taken = words if same.isEmpty() else words.join(same, ["doc_id", "page"], "left_anti")
    taken.select(*columns, _bucket(BUCKETS)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/words/batch={batch}")
    older = before.join(fresh.select("doc_id").distinct(), "doc_id", "left_semi").join(fresh.select("doc_id", "page"), ["doc_id", "page"], "left_anti")
    older = stored(older, "older-pages")
    seen = fresh.select("doc_id", "n").unionByName(older.select("doc_id", "n")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("n").alias("n"))
    if expected is not None:
        wanted = expected.select("doc_id", F.col("n_pages").alias("_wanted"))
        seen = seen.join(wanted, "doc_id", "left").filter(F.col("n_pages") >= F.coalesce("_wanted", F.lit(0))).drop("_wanted")
    ready = stored(seen, "ready-documents")
    # Every document with a fresh page is ready unless some have to wait.
    of_ready = lambda rows: rows if expected is None else rows.join(ready.select("doc_id"), "doc_id", "left_semi")
    here = spark.read.schema(S.words_schema(doc_type).add("bucket", T.IntegerType())).parquet(f"{store}/words/batch={batch}").select(*columns)
    there = _earlier_words(spark, store, doc_type, of_ready(older))
    every = here if there is None else here.unionByName(there.select(*columns))
    found = statement.transactions(of_ready(every), sizes=ready.select("doc_id", "n"), **options)
    found.write.mode("overwrite").parquet(f"{store}/ledger/batch={batch}")
    fresh.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/pages/batch={batch}")
    # Last, so that readers never see a document whose rows are not there yet.
    ready.write.mode("overwrite").parquet(f"{store}/deliveries/batch={batch}")
    _compacted(spark, store, doc_type, batch)


def start(spark: SparkSession, source: str, store: str, doc_type: T.DataType | None = None, fmt: str = "parquet",
          trigger: dict | None = None, max_files: int | None = None, **options):
    """Start the intake; returns the running query."""
    doc_type = doc_type or T.StringType()
    reader = spark.readStream.schema(S.words_schema(doc_type)).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    words = reader.load(source)
    return (
        words.writeStream.foreachBatch(lambda df, n: take_batch(df, n, store, doc_type, **options))
        .option("checkpointLocation", f"{store}/progress")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_available(spark: SparkSession, source: str, store: str, doc_type: T.DataType | None = None, **options) -> None:
    """Take in everything that has been delivered so far, then stop."""
    start(spark, source, store, doc_type, **options).awaitTermination()


def current_ledger(spark: SparkSession, store: str, doc_type: T.DataType | None = None) -> DataFrame:
    """Rows of the newest reading of each document."""
    doc_type = doc_type or T.StringType()
    schema = S.transactions_schema(doc_type)
    schema = schema.add("negative", T.BooleanType()).add("reclassified", T.BooleanType()).add("batch", T.LongType())
    if not _exists(spark, f"{store}/ledger"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(f"{store}/ledger")
    newest = latest(deliveries(spark, store, doc_type)).select("doc_id", "batch")
    return rows.join(newest, ["doc_id", "batch"], "left_semi")


def waiting(spark: SparkSession, store: str, expected: DataFrame, doc_type: T.DataType | None = None) -> DataFrame:
    """doc_id, n_pages, n_seen: expected documents some of whose pages are there and some not."""
    doc_type = doc_type or T.StringType()
    last = max(_numbers(spark, f"{store}/pages", "batch"), default=-1)
    seen = pages_before(spark, store, doc_type, last + 1).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_seen"))
    return expected.select("doc_id", "n_pages").join(seen, "doc_id").filter(F.col("n_seen") < F.col("n_pages"))
