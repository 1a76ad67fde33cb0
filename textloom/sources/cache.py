"""Validated columnar side-caches: a Parquet folder beside the file, with the signature of what was read."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from textloom import errors
from textloom.errors import EngineError
from textloom.options import ReadOptions
from textloom.sources import files
from textloom.sources.infer import Schema

VERSION = 1
SUFFIX = ".tlcache"
SIGNATURE = "_signature.json"


def signature(spark: SparkSession, path: str, options: ReadOptions, schema: Schema) -> dict:
    """What must be equal for a cache to stand for the file: dialect, sampled rows, size, time."""
    size, changed = files.stat(spark, path)
    dialect = {k: v for k, v in asdict(options).items() if k not in ("cache", "overwrite_cache")}
    rows = hashlib.sha256(json.dumps(schema.sample, ensure_ascii=False).encode()).hexdigest()
    return {"version": VERSION, "options": dialect, "names": schema.names, "kinds": schema.kinds, "size": size, "mtime_ns": changed, "sample": rows}


def stored(folder: str) -> dict:
    try:
        with open(os.path.join(folder, SIGNATURE), encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        raise EngineError(errors.CACHE_SAMPLE_DIFFERS, f"Cache {folder} has no signature") from None


def is_cache(path: str) -> bool:
    return path.endswith(SUFFIX) and os.path.isdir(path)


def validate(folder: str, now: dict) -> None:
    """A cache that isn't of this file, as it is now and as it is to be read, is refused."""
    was = stored(folder)
    if was.get("sample") != now["sample"] and all(was.get(k) == now[k] for k in ("version", "options", "size")):
        raise EngineError(errors.CACHE_SAMPLE_DIFFERS, f"Cache {folder}: the rows sampled from the file have changed")
    for key, value in now.items():
        if was.get(key) != value:
            raise EngineError(errors.CACHE_DIFFERS, f"Cache {folder} differs from its file in {key}: {was.get(key)} was cached, {value} is asked for")


def write(df: DataFrame, folder: str, sign: dict) -> None:
    """Written aside and renamed, so a reader sees the whole of a cache or none."""
    aside = f"{folder}.{uuid.uuid4().hex}"
    names = df.columns
    df.toDF(*[f"f{i}" for i in range(len(names))]).write.parquet(aside)
    with open(os.path.join(aside, SIGNATURE), "w", encoding="utf-8") as f:
        json.dump(sign | {"names": names}, f, ensure_ascii=False)
    shutil.rmtree(folder, ignore_errors=True)
    os.rename(aside, folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).toDF(*stored(folder)["names"])
