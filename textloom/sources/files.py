"""Files by name: local ones through Python, others through Hadoop's file systems, globs in sorted order."""

from __future__ import annotations

import glob
import gzip
import os

from pyspark.sql import SparkSession

from textloom import errors
from textloom.errors import EngineError

MOST_FILES = 500


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file://")


def local(path: str) -> str:
    return os.path.realpath(os.path.expanduser(path.removeprefix("file://")))


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    if is_remote(path):
        p, fs = _fs(spark, path)
        return bool(fs.exists(p))
    return os.path.exists(local(path))


def expand(spark: SparkSession, name: str, skip_suffix: str) -> list[str]:
    """The file itself if there is one, else what the pattern matches, sorted, without caches; at most MOST_FILES."""
    if is_remote(name):
        p, fs = _fs(spark, name)
        found = [name] if fs.exists(p) else [s.getPath().toString() for s in (fs.globStatus(p) or [])]
    elif os.path.exists(local(name)):
        found = [local(name)]
    else:
        found = [os.path.realpath(x) for x in glob.glob(os.path.expanduser(name.removeprefix("file://")))]
    found = sorted(x for x in found if not x.rstrip("/").endswith(skip_suffix) or x == name)
    if not found:
        raise EngineError(errors.FILE_MISSING, f"No files matching '{name}' have been found")
    if len(found) > MOST_FILES:
        raise EngineError(errors.TOO_MANY_FILES, f"Too many files for {name}: {len(found)}, at most {MOST_FILES} are read as one table")
    return found


def stat(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size and modification time (ns)."""
    if is_remote(path):
        p, fs = _fs(spark, path)
        s = fs.getFileStatus(p)
        return s.getLen(), s.getModificationTime() * 1_000_000
    s = os.stat(local(path))
    return s.st_size, s.st_mtime_ns


def stamp(spark: SparkSession, path: str) -> tuple[int, ...]:
    """What changes with a file's content, even where it is written anew with equal size within a tick of the clock."""
    if is_remote(path):
        return stat(spark, path)
    s = os.stat(local(path))
    return s.st_size, s.st_mtime_ns, s.st_ctime_ns, s.st_ino


def magic(spark: SparkSession, path: str, n: int = 16) -> bytes:
    if is_remote(path):
        p, fs = _fs(spark, path)
        if fs.getFileStatus(p).isDirectory():
            return b""
        got = spark.sparkContext.binaryFiles(path, 1).map(lambda kv: kv[1][:n]).first() if fs.getFileStatus(p).getLen() < 1 << 20 else b""
        return bytes(got)
    if os.path.isdir(local(path)):
        return b""
    with open(local(path), "rb") as f:
        return f.read(n)


def is_gzip(path: str, forced: bool) -> bool:
    return forced or path.endswith(".gz")


def head(spark: SparkSession, path: str, gzipped: bool, size: int) -> bytes:
    """The first `size` bytes, unpacked; the whole of a smaller file."""
    if is_remote(path):
        rows = spark.read.text(path).limit(max(64, size // 64)).collect()
        return "\n".join([r[0] for r in rows] + [""]).encode()[:size]
    with gzip.open(local(path)) if is_gzip(path, gzipped) else open(local(path), "rb") as f:
        return f.read(size)
