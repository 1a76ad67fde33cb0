"""A training corpus from the documents table, in five stages.

Each stage takes the documents its predecessor kept, as written Parquet, and
returns documents with all their columns; the last returns packed pieces.

Defined cases, for each stage: a null text is judged as an empty one and stays
null; a null or repeated id keeps each row's own text; columns of any name pass
through untouched, but for `text` and `n_chars`, which follows a changed text;
an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import minhash, packing, pii, quality, substrings
from textloom.llm.common import delete, keyed, shared_dir


def _with_text(docs: DataFrame, row: str, text: DataFrame) -> DataFrame:
    """docs with the texts of (*KEY, text) in place of their own, n_chars following, and without the row numbers."""
    new = text.select(*[F.col(c).alias(f"__new_{c}") for c in text.columns])
    same = [a == new[f"__new_{c}"] for a, c in zip(substrings.key_of(docs, row), substrings.KEY, strict=True)]
    both = docs.join(new, same, "left")
    return _counted(both.select(*[F.coalesce(new["__new_text"], docs[c]).alias(c) if c == "text" else docs[c] for c in docs.columns if c != row]))


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade (good and not toxic) is at least a half; all, if none is rated."""
    model = quality.fit(docs, quality.ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    return quality.select(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near-duplicates.

    Rows of one id and one text are one document. Rows without an id, and those
    of an id that has unlike texts, are documents of their own, after all others.
    """
    rows, key = keyed(docs)
    found = minhash.near_duplicates(rows, words=5, percent=80, id_col=key)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    left = rows.join(gone, rows[key] == gone["__gone"], "left_anti")
    return left.dropDuplicates([key]).drop(key)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words or more that a document before has too; a text may become empty, its row stays."""
    rows, row = substrings.numbered(docs)
    return _with_text(rows, row, substrings.shortened(rows, row, length=20))


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; texts without any stay as they are."""
    return _counted(pii.redacted(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences of at most 1024; an empty text is its end token alone."""
    found = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=2, capacity=1024)
    return packing.pack(found, 1024)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("PII", pii_redaction),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the fitted classifiers nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet to the shared folder and read again; what the next stage has read is deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/textloom-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            delete(spark, f"{top}/{k - 1}")
    return docs
