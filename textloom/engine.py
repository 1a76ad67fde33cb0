"""The engine: SQL whose tables are files, as lazy DataFrames or as a result envelope."""

from __future__ import annotations

import os
import re
import sys
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from textloom import errors
from textloom.errors import EngineError, translated
from textloom.functions.dialect import COMPAT, OWN
from textloom.operators import bands, frames, repair, sqltext
from textloom.options import ReadOptions
from textloom.sources import cache, delimited, files, sqlite
from textloom.sources.infer import Schema

_NAMES = {"-": "_dash_", ".": "_dot_", "?": "_qm_", "/": "_slash_", "\\": "_backslash_", ":": "_colon_", " ": "_space_", "+": "_plus_", "*": "_star_"}
_COLUMNAR = (".parquet", ".orc", ".json")


def table_name(path: str) -> str:
    """A legal name for a file's table: its base name without database or cache suffix, odd characters spelled out."""
    name = re.sub(r"\.(tlcache|sqlite3?|db)$", "", os.path.basename(path.rstrip("/")) or path)
    name = "".join(_NAMES.get(c, c) for c in name)
    name = re.sub(r"\W", "_", name)
    return f"t_{name}" if re.match(r"\d", name) else name


@dataclass
class TableInfo:
    """A resolved table: how it was named, what it is, where it comes from, and its columns."""

    name: str
    source_type: str
    sources: list[str]
    view: str
    columns: list[tuple[str, str]]
    frame: DataFrame
    warnings: list[str] = field(default_factory=list)


@dataclass
class Result:
    """What a query gave: a status, a lazy frame, and what was loaded for it."""

    status: str = "ok"
    frame: DataFrame | None = None
    error: EngineError | None = None
    warnings: list[str] = field(default_factory=list)
    tables: dict[str, TableInfo] = field(default_factory=dict)
    new_tables: dict[str, TableInfo] = field(default_factory=dict)
    sql: str = ""

    @property
    def columns(self) -> list[str]:
        return self.frame.columns if self.frame is not None else []

    def rows(self) -> list[tuple]:
        """All rows on the driver."""
        if self.error:
            raise self.error
        try:
            return [tuple(r) for r in self.frame.collect()] if self.frame is not None else []
        except Exception as e:
            raise translated(e) from e


class Engine:
    """Resolves table names to sources once, and runs queries over them in a session of its own.

    compat: the dialect's SQLite ways (LIKE without case, functions by SQLite's
    names, null for a division by zero); without it the text is Spark SQL, but
    for file names and the dialect's own functions.
    """

    def __init__(self, spark: SparkSession | None = None, defaults: ReadOptions | None = None, streams: dict | None = None, compat: bool = True) -> None:
        if spark is None:
            from textloom.session import session

            spark = session(os.environ.get("TEXTLOOM_MASTER", "local[*]"))
        self.base = spark
        self.spark = spark.newSession()
        for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes"):
            if (value := spark.conf.get(key, None)) is not None:
                self.spark.conf.set(key, value)
        self.compat = compat
        self.spark.conf.set("spark.sql.ansi.enabled", "false" if compat else "true")
        self.defaults = (defaults or ReadOptions()).checked()
        self.streams = dict(streams or {})
        self.tables: dict[str, TableInfo] = {}
        self.functions: dict = {}

    # --- sources

    def register_stream(self, name: str, stream) -> None:  # noqa: ANN001
        self.streams[name] = stream

    def register_function(self, name: str, make) -> None:  # noqa: ANN001
        """A dialect function of one's own: make(argument texts) gives Spark SQL text."""
        self.functions[name.lower()] = make

    def load(self, name: str, sample_only: bool = False, **changes) -> TableInfo:  # noqa: ANN003
        """Resolve a table ahead of queries, with options of its own."""
        options = self.defaults.merged(**changes).checked()
        if name not in self.tables or sample_only:
            self.tables[name] = self._resolve(name, options, sample_only)
        return self.tables[name]

    def unload(self) -> None:
        for info in self.tables.values():
            self.spark.catalog.dropTempView(info.view)
        self.tables.clear()

    close = unload

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:  # noqa: ANN002
        self.close()

    def _view(self, name: str, frame: DataFrame, **info) -> TableInfo:  # noqa: ANN003
        base = table_name(name) or "t"
        view, k = base, 1
        used = {t.view.lower() for t in self.tables.values()}
        while view.lower() in used:
            k += 1
            view = f"{base}_{k}"
        frame.createOrReplaceTempView(f"`{view}`")
        kinds = {"bigint": "int", "int": "int", "double": "real", "float": "real", "string": "text", "binary": "blob"}
        return TableInfo(name, view=view, columns=[(c, kinds.get(t, t)) for c, t in frame.dtypes], frame=frame, **info)

    def _resolve(self, name: str, options: ReadOptions, sample_only: bool) -> TableInfo:
        """In order: stream, file:::table, cache, SQLite file, columnar file, the cache beside a file, delimited text."""
        spark = self.spark
        if name in self.streams or name == "-":
            stream = self.streams.get(name, sys.stdin.buffer if name == "-" else None)
            frame, schema = delimited.from_stream(spark, stream, options)
            return self._view("stdin" if name == "-" else name, frame, source_type="data-stream", sources=[name], warnings=schema.warnings)
        if ":::" in name:
            path, table = name.split(":::", 1)
            if not files.exists(spark, path):
                raise EngineError(errors.FILE_MISSING, f"No files matching '{path}' have been found")
            if cache.is_cache(path):
                return self._cached(name, path, table, options)
            if files.magic(spark, path) == sqlite.MAGIC:
                return self._sqlite(name, files.local(path), table, sample_only)
            raise EngineError(errors.UNKNOWN_TYPE, f"Cannot tell the type of {path}; tables are named only inside SQLite files and caches")
        if cache.is_cache(name):
            return self._cached(name, name, None, options)
        there = files.exists(spark, name)
        if there and files.magic(spark, name) == sqlite.MAGIC:
            return self._sqlite(name, files.local(name), None, sample_only)
        if suffix := next((s for s in _COLUMNAR if name.rstrip("/*").endswith(s)), None):
            if not there and not any(c in name for c in "*?["):
                raise EngineError(errors.FILE_MISSING, f"No files matching '{name}' have been found")
            frame = spark.read.format(suffix[1:]).load(name)
            return self._view(name, frame, source_type="columnar-file", sources=[name])
        return self._delimited(name, options, sample_only)

    def _sqlite(self, name: str, path: str, table: str | None, sample_only: bool) -> TableInfo:
        picked = sqlite.pick_table(path, table)
        frame = sqlite.read(self.spark, path, picked)
        if sample_only:
            frame = frame.limit(self.defaults.sample_rows)
        return self._view(name if table is None else f"{os.path.basename(path)}_{picked}", frame, source_type="sqlite-file", sources=[path])

    def _cached(self, name: str, folder: str, table: str | None, options: ReadOptions) -> TableInfo:
        original = folder.removesuffix(cache.SUFFIX)
        own = table_name(original)
        if table is not None and table.lower() not in (own.lower(), "t"):
            raise EngineError(errors.CACHE_TABLE_MISSING, f"Table {table} is not in cache {folder}; it has {own}")
        cache.stored(folder)
        both = files.exists(self.spark, original)
        return self._view(name, cache.read(self.spark, folder), source_type="cache-file-with-original" if both else "cache-file", sources=[folder])

    def _delimited(self, name: str, options: ReadOptions, sample_only: bool) -> TableInfo:
        spark = self.spark
        paths = files.expand(spark, name, cache.SUFFIX)
        schema = delimited.schema_of(spark, paths, options, not sample_only)
        single = len(paths) == 1 and not any(c in name for c in "*?[") and not files.is_remote(paths[0])
        folder = paths[0] + cache.SUFFIX if single else ""
        there = bool(folder) and os.path.isdir(folder)
        anew = options.overwrite_cache and options.cache == "readwrite"
        if there and options.cache in ("read", "readwrite") and not sample_only and not anew:
            cache.validate(folder, cache.signature(spark, paths[0], options, schema))
            return self._view(name, cache.read(spark, folder), source_type="cache-file-with-original", sources=[folder, *paths], warnings=schema.warnings)
        if sample_only:
            frame = self._sampled(schema, options)
        else:
            frame = delimited.read(spark, paths, options, schema)
        if single and options.cache == "readwrite" and not sample_only:
            cache.write(frame, folder, cache.signature(spark, paths[0], options, schema))
            frame = cache.read(spark, folder)
        return self._view(name, frame, source_type="file-with-unused-cache" if there else "file", sources=paths, warnings=schema.warnings)

    def _sampled(self, schema: Schema, options: ReadOptions) -> DataFrame:
        import pyarrow as pa

        batches = list(delimited.to_batches(iter(schema.sample), replace(options, mode="relaxed"), schema, "sample"))
        arrow = {"int": pa.int64(), "real": pa.float64(), "text": pa.string()}
        made = pa.Table.from_batches(batches) if batches else pa.table({f"f{i}": pa.array([], arrow[k]) for i, k in enumerate(schema.kinds)})
        return self.spark.createDataFrame(made).toDF(*schema.names)

    # --- queries

    def rewritten(self, text: str, sample_only: bool = False, **changes) -> tuple[str, dict[str, TableInfo]]:  # noqa: ANN003
        """Spark SQL for the query, and the tables it reads."""
        if not sqltext.is_select(text):
            raise EngineError(errors.SQL, "Only SELECT, WITH and VALUES statements are run")
        used: dict[str, TableInfo] = {}

        def resolve(name: str) -> str:
            used[name] = self.load(name, sample_only, **changes)
            return f"`{used[name].view}`"

        text = text.strip().rstrip(";")
        if self.compat:
            text = sqltext.name_columns(text)
        out, _ = sqltext.with_tables(text, resolve)
        if self.compat:
            out = sqltext.rewrite_operators(frames.rewrite_frames(out))
        return sqltext.rewrite_calls(out, OWN | (COMPAT if self.compat else {}) | self.functions), used

    def _settled(self, text: str, used: dict[str, TableInfo]) -> tuple[DataFrame, str]:
        text = bands.counted(text, {t.view: t.frame for t in used.values()}, lambda part: self._analysed(part, used)[0])
        return self._analysed(text, used)

    def _analysed(self, text: str, used: dict[str, TableInfo]) -> tuple[DataFrame, str]:
        if not self.compat:
            return self.spark.sql(text), text
        decimals = bool(re.search(r"(?i)\bdecimal\b", text)) or any(kind.startswith("decimal") for t in used.values() for _, kind in t.frame.dtypes)
        return repair.analysed(self.spark, text, decimals)

    def sql(self, text: str, **changes) -> DataFrame:  # noqa: ANN003
        """The query as a lazy DataFrame; failures are raised."""
        return self._settled(*self.rewritten(text, **changes))[0]

    def execute(self, text: str, sample_only: bool = False, **changes) -> Result:  # noqa: ANN003
        """The query as an envelope; failures are returned in it."""
        before = set(self.tables)
        try:
            if isinstance(text, bytes):
                raise EngineError(errors.NOT_UNICODE, "Query must be text, not bytes")
            out, used = self.rewritten(text, sample_only, **changes)
            frame, out = self._settled(out, used)
        except UnicodeError as e:
            return Result("error", error=EngineError(errors.DECODE, str(e)))
        except Exception as e:  # noqa: BLE001
            return Result("error", error=translated(e))
        warnings = [f"{w} ({t.name})" for t in used.values() for w in t.warnings]
        return Result("ok", frame, None, warnings, used, {k: t for k, t in used.items() if k not in before}, out)

    def analyze(self, text: str, **changes) -> Result:  # noqa: ANN003
        """Like execute(), on samples of the tables only."""
        return self.execute(text, sample_only=True, **changes)

    def save(self, text: str, target: str, **changes) -> str:  # noqa: ANN003
        """Write every table of the query to a SQLite file, or as Parquet under a folder; returns the query over them. The query isn't run."""
        from textloom.operators import sinks

        if os.path.exists(target):
            raise EngineError(errors.TARGET_EXISTS, f"Target {target} exists already")
        out, used = self.rewritten(text, **changes)
        try:
            sinks.save_tables({t.view: t.frame for t in used.values()}, target)
        except Exception as e:
            raise translated(e) from e
        return out
