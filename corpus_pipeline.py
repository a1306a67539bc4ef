"""Corpus preparation: documents of low quality go, near copies go, benchmark passages and secrets are
taken out, and what is left becomes SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.decontaminate import remove_contamination
from quaystone.llm.quality import fit_quality, keep_quality
from quaystone.llm.secrets import redact_secrets
from quaystone.llm.sentencepiece import encode
from quaystone.llm.simhash import keep_one
from quaystone.llm.textblocks import forget, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    Null and empty texts get the score of a text without words (the bias) and stay or go by it; repeated rows
    are judged alike; texts of any length are read whole; an empty table stays empty; without labels every score is
    one half and every document goes. All columns are kept, whatever their names.
    """
    return keep_quality(docs, *fit_quality(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of at least 0.8.

    Of a group the row of the smallest doc_id stays, a null doc_id last, ties by the text's hash, and of rows that
    agree in both one; null and empty texts are a group; a text of fewer words than a shingle is one shingle;
    texts of any length are compared whole; an empty table stays empty. All columns are kept.
    """
    return keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that benchmark windows cover.

    Every document stays, also one of which no word is left; null texts stay null, empty ones empty; repeated
    rows are treated alike; texts of any length are searched whole; an empty table, or an empty benchmark, changes
    nothing. n_chars follows the text; other columns are kept.
    """
    return remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by the names of their kinds.

    Every document stays; null texts stay null, empty ones empty; repeated rows are treated alike; of spans that
    overlap the first is named; texts of any length are scanned whole; an empty table stays empty. n_chars follows the
    text; other columns are kept.
    """
    return redact_secrets(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids, the ids' number and score.

    Null and empty texts have no ids; repeated rows are encoded alike; giant texts are encoded in chunks; an empty
    table stays empty. Columns named piece_ids, piece_score or n_pieces are replaced, others are kept.
    """
    return encode(docs).withColumn("n_pieces", F.size("piece_ids").cast("bigint"))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("secrets", secrets),
    ("pieces", pieces),
]

#: SQL can't express a trained classifier or the segmentation; tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
            forget(before)  # the table of the stage before; the given one is left alone
    return docs
