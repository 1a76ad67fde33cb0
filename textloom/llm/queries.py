"""The operators as registered queries: production parameters, whole tables, the contracts' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import documents
from textloom.llm.oracles import NEAR_DEDUP, SUBSTRINGS


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import bpe

    return bpe.encode_digests(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.tiktoken"), _pattern())


def op2_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import chunking

    return chunking.edited_likeness(documents(spark, sf_dir))


def op3_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import packing

    found = packing.pieces(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.tiktoken"), _pattern(), end_id=2, capacity=1024)
    return packing.pack(found, 1024)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import minhash

    return minhash.near_duplicates(documents(spark, sf_dir), words=2, percent=80)


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from textloom.llm import sharding

    dealt = sharding.shard(sharding.document_rows(documents(spark, sf_dir)), 40, seed=5)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import jpeg

    return jpeg.text_media_digests(documents(spark, sf_dir))


def op7_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import pii

    return pii.find(documents(spark, sf_dir))


def op8_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm import substrings

    return substrings.removals(documents(spark, sf_dir), length=20)


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from textloom.llm import quality

    docs = documents(spark, sf_dir)
    model = quality.fit(docs, quality.ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    return quality.score(docs, model, ["doc_id"]).withColumn("kept", F.coalesce(F.col("tail_top") >= 0.5, F.lit(True)))


def op10_kneser_ney_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from textloom.llm import langid

    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_chunk_fingerprints": op2_chunk_fingerprints,
    "op3_bin_completion": op3_bin_completion,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_hypergeometric_shards": op5_hypergeometric_shards,
    "op6_jpeg_media": op6_jpeg_media,
    "op7_weak_pii": op7_weak_pii,
    "op8_seed_extend": op8_seed_extend,
    "op9_ordinal_quality": op9_ordinal_quality,
    "op10_kneser_ney_langid": op10_kneser_ney_langid,
}

#: DuckDB SQL, where SQL can express an operator.
ORACLE_SQL: dict[str, str] = {"op4_minhash_near_dedup": NEAR_DEDUP, "op8_seed_extend": SUBSTRINGS}
