"""A training corpus from documents: quality, near copies, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import linear, packing, passages, pii, setjoin
from harrow.llm.common import delete_folder, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3, learned from the labels of those among docs.

    Null and empty texts have the score of the bias; repeated rows all stay or all go; without labels all stay."""
    weights = linear.train(docs, table(spark, sf_dir, "labels"), "quality", linear.QUALITY)
    return linear.accepted(docs, weights, 0.3, linear.QUALITY)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (5-word shingles, similarity 0.8) the document with the smallest doc_id.

    Where an id has several texts, each goes or stays by its own; of repeated rows one stays. Null, empty and blank texts,
    which are like nothing, and rows without doc_id stay."""
    return setjoin.one_of_each(docs, 5, (4, 5))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller doc_id has too.

    All rows stay, some with an empty text; of an id with several texts, each is cut by its own passages. Null and empty
    texts, rows without doc_id and repeats within one text stay as they are."""
    return _measured(passages.without_passages(docs, passages.repeated_passages(docs)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. All rows stay; null and empty texts stay as they are."""
    return _measured(pii.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in windows of 1024. Null texts are empty; each row is packed, repeated ones too."""
    return packing.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("pack", pack)]
#: SQL can't train the classifier or run the tokenizer; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, through Parquet in the shared folder. A stage's
    input is deleted once its output is written; the last stage's folder, which the result reads, stays."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        out = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            delete_folder(spark, before)
        before = out
    return docs
