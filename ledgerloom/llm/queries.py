"""The registered queries of this subpackage: each applies one operator to its whole table.

Their SQL counterparts are in :mod:`ledgerloom.llm.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path, stored
from . import chat, classifier, hardneg, linedup, mixing, neardup, pieces, quality, repair, secrets, simhash, tokenbin, topk
from .shipping import ship


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    """Secrets of every document: a document is a path with one version. They come in two deliveries, the lower half of the ids and
    then the rest; the second scans only blobs that the first did not bring."""
    versions = table(spark, d, "documents").select("doc_id", "text")
    middle = versions.agg(F.avg("doc_id")).first()[0] or 0.0
    early = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    path = new_path(spark, "blob-ledger")
    secrets.deliver(path, versions.where(early), "text")
    ledger = secrets.deliver(path, versions.where(~early), "text")
    found = secrets.findings(versions, "text", ledger)
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))

    def count(kind: str) -> DataFrame:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(r.kind) for r in secrets.BASE],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


def op2_line_quality(spark: SparkSession, d: str) -> DataFrame:
    """Line-first rules on every document."""
    return quality.judged(table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_bad_lines", "lost_chars",
    )


def op3_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a similarity of 0.8 or more."""
    return neardup.groups(table(spark, d, "documents"))


def op4_chat_format(spark: SparkSession, d: str) -> DataFrame:
    """All conversations and conversation -7, formatted, and read back from the formatted text."""
    told = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"),
    )
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_chats(chat.format_chats(rows))
    loss = F.array_join("loss_texts", "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_fourier_quality(spark: SparkSession, d: str) -> DataFrame:
    """A quality score of every document, learned from the labels outside the held-out fold."""
    stats = stored(classifier.described(table(spark, d, "documents")), "statistics")
    model = classifier.fit(stats, table(spark, d, "labels"))
    return classifier.scored(stats, model)


def op6_piece_encoding(spark: SparkSession, d: str) -> DataFrame:
    """All texts as SentencePiece ids, decoded again: counts, checksum of the ids and whether the text came back."""
    return pieces.encoded(table(spark, d, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every line of the documents that an equal line or one within one edit precedes."""
    return linedup.removed(table(spark, d, "documents")).select(
        F.col("doc").alias("doc_id"), F.col("no").cast("long").alias("line_no"), F.col("kept_doc").alias("kept_doc_id"),
        F.col("kept_no").cast("long").alias("kept_line_no"), "near",
    )


def op8_pivot_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best inner products of every fiftieth vector with all others."""
    vectors = stored(topk.prepared(table(spark, d, "embeddings"), "vec_id", "embedding", 256), "vectors")
    asking = vectors.where(F.col("id") % 50 == 0).groupBy("id").agg(F.min("v").alias("v"))
    return topk.search(vectors, asking, 5)


def op9_temperature_mix(spark: SparkSession, d: str) -> DataFrame:
    """All documents in a mix of 97 percent of the entropy of equal weights, at most four epochs of a source, as many tokens as there are."""
    return mixing.decisions(table(spark, d, "documents"), budget_share=1.0, entropy=0.97, repetition=4.0)


def op10_token_store(spark: SparkSession, d: str) -> DataFrame:
    """All texts as token ids in a store, read back from it."""
    path = new_path(spark, "token-store")
    tokenbin.write_store(table(spark, d, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return tokenbin.read_documents(spark, path)


def op11_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """The hard negatives of every hundredth vector, a seventh of the labels moved on by one first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hardneg.prepared(table(spark, d, "embeddings"), F.col("vec_id"), moved, F.col("embedding"), 256)
    return hardneg.mined(rows, F.col("id") % 100 == 0)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows spoilt by the checksum of their place."""
    known = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fate = F.pmod(F.crc32(F.concat(known["conv_id"], F.lit(":"), known["turn"])), F.lit(20))
    text = F.when(fate == 1, "").when(fate == 2, F.translate(known["text"], ".!?", "")).otherwise(known["text"])
    return conversations.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(known["role"]).alias("role"), text.alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def op12_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    """All conversations, damaged and repaired: faults, cost, edits and a hash of the repaired turns."""
    return repair.digests(repair.repaired(damaged(table(spark, d, "conversations"))))


def op13_gray_simhash(spark: SparkSession, d: str) -> DataFrame:
    """Components of documents whose fingerprints differ in three bits at most."""
    found = simhash.groups(table(spark, d, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_line_quality, op3_near_duplicates, op4_chat_format, op5_fourier_quality, op6_piece_encoding, op7_line_dedup,
        op8_pivot_topk, op9_temperature_mix, op10_token_store, op11_hard_negatives, op12_conversation_repair, op13_gray_simhash,
    )
}
