"""A corpus pipeline: toxic documents go, then repeated lines, then near copies; personal data are masked; the rest is packed.

Each stage works on all that the stage before it kept. All but the last return the
columns of documents, whatever further ones there are; where a stage changes texts,
n_chars follows.

Null texts count as empty and stay null. Rows with null ids take part in all stages but
the removal of lines and of copies, which leave them as they are. Rows that repeat an
id stay or go together as near copies. A document whose lines have all gone stays with
an empty text; of all documents without words one stays. Empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argolith.llm import line_dedup, packing, pii, shingle_dedup, toxicity
from argolith.llm.common import materialise, table
from argolith.session import ship


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model trained on them and the labels rejects go."""
    ship(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; a document stays even if it has no line left."""
    ship(spark)
    return _counted(line_dedup.dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles 0.8 alike) the document with the smallest id stays."""
    ship(spark)
    return shingle_dedup.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    return _counted(pii.mask(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of a few context sizes."""
    ship(spark)
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]

#: The stages go beyond what SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
