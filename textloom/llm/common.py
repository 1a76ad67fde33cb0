"""What the operators share: shipping code, reading tables, Arrow text access, durable cuts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.ship import ship as ship

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def two(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (null: empty), under names of their own."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only where none is named and all runs in this process (tests, local runs)."""
    sc = spark.sparkContext
    to = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if to:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(to)
        return to
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends in files that survive a lost executor, and partitions stay as they are."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame, name: str) -> DataFrame:
    """Like cut(), but as compressed Parquet in the shared folder; partitions may be read back differently."""
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(to)
    out = spark.read.schema(df.schema).parquet(to)
    out._textloom_table = to
    return out


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Delete the files of table() results that nothing to come reads any more."""
    for df in tables:
        delete(df.sparkSession, df._textloom_table)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of phases whose results are already in tables."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets without copying rows; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `size` bytes of text (one row at least): memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        _, off = text_bytes(col)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + size, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """docs with a key that no two documents share, and its name: the id where it tells a row's text, else a number above all ids.

    Rows without an id, and rows whose id has unlike texts, get numbers, which
    are written once; rows of one id and one text are one document.
    """
    key, own = free_name(docs.columns, "__key"), docs[id_col].cast("long")
    marks = docs.select(own.alias("i"), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("m"))
    unlike = table(marks.where("i is not null").groupBy("i").agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a <> b").select(F.col("i").alias("__unlike")), "unlike")
    most = marks.agg(F.max("i")).first()[0] or 0
    rest, odd = docs.where(own.isNotNull()), docs.where(own.isNull())
    if rows_of(unlike):
        odd = odd.unionByName(docs.join(unlike, own == unlike["__unlike"], "left_semi"))
        rest = rest.join(unlike, own == unlike["__unlike"], "left_anti")
    held = table(odd.withColumn(key, F.monotonically_increasing_id() + F.lit(most + 1)), "odd-ids")
    return rest.withColumn(key, own).unionByName(held), key


def free_name(taken: list[str], wish: str) -> str:
    """A column name that isn't taken, whatever the case."""
    low = {x.lower() for x in taken}
    while wish.lower() in low:
        wish = f"_{wish}"
    return wish


def rows_of(df: DataFrame) -> bool:
    return len(df.take(1)) > 0
