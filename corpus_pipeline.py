"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every stage is written to the shared folder and read again, so that no stage recomputes an earlier one and a lost
executor costs one stage's work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import linedup, mixing, neardup, pieces, quality
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.llm.shipping import ship
from ledgerloom.sources.scratch import stored

#: The most epochs of a source in the mix. The largest source is taken once, no document is dropped.
REPETITION = 1.25
#: Words of a shingle in the near-duplicate stage; similarity 0.8.
SHINGLE = 5
#: A document that loses this share of its words to earlier lines is a near copy and goes, not only its repeated lines.
COPIED = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, then documents that fail or lose too much."""
    return quality.cleaned(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an equal or nearly equal line precedes go; documents that consist of such lines by four fifths go as a whole, so
    that no near copy stays as a fragment of the lines in which it differs."""
    return linedup.cleaned(docs, COPIED)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    ship(spark)
    return neardup.deduplicated(docs, k=SHINGLE)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, as flat a mix as the repetition limit allows; repeated documents are repeated rows."""
    return mixing.mixed(docs, repetition=REPETITION)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, the ids of each text and their checks."""
    ship(spark)
    return pieces.encoded(docs, tokenizer_path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source", "n_chars"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("source mix", source_mix),
    ("token ids", token_ids),
]

#: The stages on registers and token ids have no SQL form; the whole is tested against plain Python on a fixture.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
