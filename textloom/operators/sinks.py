"""Where tables and results go: SQLite files, Parquet folders, delimited files."""

from __future__ import annotations

import itertools
import os
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import errors
from textloom.errors import EngineError
from textloom.options import WriteOptions
from textloom.ship import ship
from textloom.sources.sqlite import quoted

_DECLARED = {"bigint": "INT", "int": "INT", "smallint": "INT", "tinyint": "INT", "boolean": "INT", "double": "REAL", "float": "REAL", "binary": "BLOB"}
CHUNK = 5_000


def save_tables(tables: dict[str, DataFrame], target: str) -> None:
    """A .sqlite/.db name, or any without a trailing slash, is one SQLite file; a folder name gets a Parquet table each, written by the executors."""
    if target.endswith("/"):
        for name, df in tables.items():
            df.write.mode("error").parquet(os.path.join(target, f"{name}.parquet"))
        return
    aside = target + ".part"
    with sqlite3.connect(aside) as con:
        for name, df in tables.items():
            write_sqlite(con, name, df, os.path.dirname(os.path.abspath(target)))
    con.close()
    os.rename(aside, target)


def write_sqlite(con: sqlite3.Connection, name: str, df: DataFrame, beside: str) -> None:
    """One table. Each task writes its rows to a SQLite file of its own, and SQLite appends those here one after another, as a file has one writer.

    The driver gets the files' names only. Where executors share no folder of
    the file system with it, the rows stream through it, a partition at a time.
    """
    columns = ", ".join(f"{quoted(c)} {_DECLARED.get(t, 'TEXT')}" for c, t in df.dtypes)
    create = f"create table {quoted(name)} ({columns})"
    insert = f"insert into {quoted(name)} values ({', '.join('?' * len(df.columns))})"
    con.execute(create)
    named = [(F.col(f"`{c.replace('`', '``')}`"), t) for c, t in df.dtypes]
    plain = df.select([(c if t in _DECLARED else F.make_valid_utf8(c.cast("string"))).alias(f"c{i}") for i, (c, t) in enumerate(named)])
    folder = _parts_folder(df.sparkSession, beside)
    if folder is None:
        rows = iter(map(tuple, plain.toLocalIterator(prefetchPartitions=True)))
        while chunk := list(itertools.islice(rows, CHUNK)):
            con.executemany(insert, chunk)
        return
    ship(df.sparkSession)
    try:
        parts = plain.mapInArrow(_part_writer(folder, create, insert), "partition int, path string, n long").collect()  # a row for each task
        con.commit()
        for _, path, n in sorted(map(tuple, parts)):
            if not os.path.exists(path):
                raise EngineError(errors.SQL, f"The driver doesn't see {path}, which an executor wrote; spark.checkpoint.dir must be a folder that all share")
            con.execute("attach ? as part", (path,))
            got = con.execute(f"insert into main.{quoted(name)} select * from part.{quoted(name)}").rowcount
            con.commit()
            con.execute("detach part")
            os.remove(path)
            if got != n:
                raise EngineError(errors.SQL, f"{path} has {got} rows of {n}")
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _parts_folder(spark: SparkSession, beside: str) -> str | None:
    """A new folder that the driver and all executors open by its path: in spark.checkpoint.dir, or beside the target where all runs on this machine."""
    sc = spark.sparkContext
    if sc.master.split("[")[0] == "local":
        return tempfile.mkdtemp(prefix=".textloom-", dir=beside)
    to = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not to:
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(to)
    store = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        return None
    folder = os.path.join(store.makeQualified(path).toUri().getPath(), f"sqlite-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return folder


def _part_writer(folder: str, create: str, insert: str):  # noqa: ANN202
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n, con = os.path.join(folder, f"{uuid.uuid4().hex}.sqlite"), 0, None  # another file for each attempt
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                if con is None:
                    con = sqlite3.connect(path, isolation_level=None)
                    con.execute("pragma journal_mode = off")
                    con.execute("pragma synchronous = off")
                    con.execute(create)
                    con.execute("begin")
                chunk = batch.slice(at, CHUNK)
                con.executemany(insert, zip(*(c.to_pylist() for c in chunk.columns), strict=True))
                n += chunk.num_rows
        if con is not None:
            con.execute("commit")
            con.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([path]), pa.array([n], pa.int64())], ["partition", "path", "n"])

    return write


def write_delimited(df: DataFrame, folder: str, options: WriteOptions, compression: str = "none") -> None:
    """Delimited part files, written by the executors; quotes are doubled and nulls empty, as rendered rows are."""
    from textloom.operators.render import quoted_column

    d = options.delimiter
    cells = [quoted_column(F.col(f"`{c.replace('`', '``')}`"), t, options) for c, t in df.dtypes]
    lines = df.select(F.concat_ws(d, *cells).alias("value"))
    lines.write.mode("error").option("compression", compression).text(folder)
