"""Readers and writers for words, ledgers and result records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators.guard import part_of_page


# --- words -----------------------------------------------------------------
def read_words(spark: SparkSession, path: str, fmt: str = "parquet", doc_type: T.DataType | None = None,
               **options) -> DataFrame:
    """Words under a fixed schema; only the columns a plan uses are read from columnar files."""
    return spark.read.schema(S.words_schema(doc_type)).options(**options).format(fmt).load(path)


def read_words_checked(spark: SparkSession, path: str, fmt: str = "json", doc_type: T.DataType | None = None,
                       **options) -> tuple[DataFrame, DataFrame]:
    """(words, damage) of a folder of word files, json, csv or parquet; nothing unreadable is dropped without a trace.

    ``damage``: file, doc_id, reason. A record that cannot be read is one row, with its document where the record still names it; a
    file from which no record could be read is one row without a document. A file that breaks off in its middle gives
    the records before that place (parquet: whole row groups)."""
    schema = S.words_schema(doc_type)
    plain = fmt not in ("json", "csv")
    shape = schema if plain else T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    reader = spark.read.schema(shape).option("ignoreCorruptFiles", True).options(**options)
    if not plain:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    rows = reader.format(fmt).load(path).select("*", F.col("_metadata.file_path").alias("_file"))
    broken = F.lit(False) if plain else F.col("_broken").isNotNull()
    words = rows.filter(~broken).select(*schema.names)
    kind = schema["doc_id"].dataType
    told = rows.select("_file", *([] if plain else ["doc_id", "_broken"]))
    of_records = told.limit(0).select("_file", F.lit(None).cast(kind).alias("doc_id"), F.lit("").alias("reason"))
    if not plain:
        named = F.when(F.lit(fmt == "json"), F.nullif(F.regexp_extract("_broken", r'"doc_id"\s*:\s*"?([^",}]+)', 1), F.lit("")))
        of_records = told.filter("_broken IS NOT NULL").select("_file", F.coalesce("doc_id", named.try_cast(kind)).alias("doc_id"), F.lit("unreadable record").alias("reason"))
    # Paths and sizes only: the content column is not asked for, so no file is opened for the list.
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("_file"))
    read = told.select(F.regexp_replace("_file", "^file:/+", "/").alias("_seen")).distinct()
    silent = listed.join(read, F.regexp_replace("_file", "^file:/+", "/") == F.col("_seen"), "left_anti")
    of_files = silent.select("_file", F.lit(None).cast(kind).alias("doc_id"), F.lit(S.ABORT_FILE).alias("reason"))
    return words, of_records.unionByName(of_files).withColumnRenamed("_file", "file")


def damaged_documents(damage: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """doc_id, abort_reason of documents that damage touches. ``files``: doc_id, file (name) of documents, where it is known
    which file holds which; a damaged file fails all of them, as does a broken record that names no document."""
    own = damage.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.format_string(S.ABORT_RECORDS, F.count(F.lit(1))).alias("abort_reason"))
    if files is None:
        return own
    name = F.element_at(F.split("file", "/"), -1)
    whole = damage.filter(F.col("doc_id").isNull()).groupBy(name.alias("file")).agg(F.max(F.col("reason") == S.ABORT_FILE).alias("_all"), F.count(F.lit(1)).alias("_n"))
    reason = F.when(F.col("_all"), S.ABORT_FILE).otherwise(F.format_string(S.ABORT_RECORDS, F.col("_n")))
    of_files = files.select("doc_id", "file").join(whole, "file").select("doc_id", reason.alias("abort_reason"))
    return own.unionByName(of_files).groupBy("doc_id").agg(F.max("abort_reason").alias("abort_reason"))


def pages_of(words: DataFrame) -> DataFrame:
    """Every (document, page) that has words."""
    return words.select("doc_id", "page").distinct()


# --- ledgers ---------------------------------------------------------------
def ledger_from_rows(spark: SparkSession, rows, doc_type: T.DataType | None = None) -> DataFrame:
    """A ledger from Python records (dicts or tuples) or from a pandas frame."""
    return spark.createDataFrame(rows, schema=S.transactions_schema(doc_type))


def write_ledger(ledger: DataFrame, path: str, fmt: str = "parquet", partition_by=(), mode: str = "errorifexists"):
    """Export as parquet, csv, json or orc."""
    writer = ledger.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("dateFormat", "yyyy-MM-dd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_ledger(spark: SparkSession, path: str, fmt: str = "parquet", doc_type: T.DataType | None = None) -> DataFrame:
    reader = spark.read.schema(S.transactions_schema(doc_type)).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("dateFormat", "yyyy-MM-dd")
    return reader.load(path)


# --- result records --------------------------------------------------------
def result_records(ledger: DataFrame, results: DataFrame, rows_key: str = "transactions",
                   page_warnings: DataFrame | None = None) -> DataFrame:
    """The result of each document with its transactions in order, as records for a JSON file.

    A document of up to ``guard.PAGES_PER_PART`` pages is one record. A longer one continues in
    further records (``part``, ``first_seq``), so no record grows with the document; each
    carries the whole ``transaction_count`` and ``n_warnings``, and the warnings of its pages.
    """
    row = F.struct(
        F.col("date_raw").alias("date"), "description", "withdrawal", "deposit", "balance",
        F.col("page").cast("int").alias("page"),
    )
    part = part_of_page().alias("part")
    grouped = ledger.groupBy("doc_id", part).agg(
        F.min("txn_seq").alias("first_seq"),
        F.sort_array(F.collect_list(F.struct("txn_seq", row.alias("row")))).alias("_rows"),
    )
    keys = results.select("doc_id", F.lit(0).cast("bigint").alias("part")).unionByName(grouped.select("doc_id", "part"))
    own = F.when(F.col("part") == 0, F.col("warnings")).otherwise(F.array().cast("array<string>"))
    if page_warnings is not None:
        told = page_warnings.groupBy("doc_id", part).agg(
            F.sort_array(F.collect_list(F.struct("page", "message")))["message"].alias("_told")
        )
        keys = keys.unionByName(told.select("doc_id", "part"))
        own = F.concat(own, F.coalesce("_told", F.array().cast("array<string>")))
    out = keys.distinct().join(results, "doc_id").join(grouped, ["doc_id", "part"], "left")
    if page_warnings is not None:
        out = out.join(told, ["doc_id", "part"], "left")
    empty = F.array().cast(T.ArrayType(S.RESULT_ROW))
    # An aborted document has a result but hands out no rows.
    kept = F.when(F.col("success"), F.col("_rows.row").cast(T.ArrayType(S.RESULT_ROW)))
    return out.select(
        "doc_id", "part", "first_seq", "success", "confidence", own.alias("warnings"), "n_warnings", "abort_reason",
        "transaction_count", F.coalesce(kept, empty).alias(rows_key),
    )


def write_results(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON records, one per line, with nulls spelled out."""
    records.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_results(spark: SparkSession, path: str, doc_type: T.DataType | None = None,
                 multi_line: bool = False) -> DataFrame:
    """Result records with their rows under ``rows``: ``data`` unless it is missing or empty,
    then ``transactions``, then none. Records without a document id take their file's name."""
    read = spark.read.schema(S.result_schema(doc_type)).option("multiLine", multi_line).json(path)
    none = F.array().cast(T.ArrayType(S.RESULT_ROW))
    rows = F.when(F.size("data") > 0, F.col("data")).otherwise(F.coalesce("transactions", none))
    if doc_type is None:
        read = read.withColumn("doc_id", F.coalesce("doc_id", F.col("_metadata.file_name")))
    return read.withColumn("rows", rows).drop("data", "transactions")


def result_rows(results: DataFrame) -> DataFrame:
    """The transactions of result records as a ledger."""
    rows = results.select(
        "doc_id", F.coalesce("first_seq", F.lit(1)).alias("_from"), F.posexplode("rows").alias("_pos", "r")
    )
    return rows.select(
        "doc_id", F.col("r.page").alias("page"),
        (F.col("_from") + F.col("_pos")).cast("bigint").alias("txn_seq"),
        F.col("r.date").alias("date_raw"),
        F.try_to_date("r.date", S.DATE_FORMAT).alias("txn_date"),
        "r.description", "r.withdrawal", "r.deposit", "r.balance",
    )
