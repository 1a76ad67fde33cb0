"""SQLite files as a Python data source, split by ranges of rowid, with filters pushed into SQLite."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from textloom import errors
from textloom.errors import EngineError

MAGIC = b"SQLite format 3\0"
BATCH_ROWS, SPLIT_ROWS = 10_000, 500_000


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.replace('?', '%3f').replace('#', '%23')}?mode=ro&immutable=1", uri=True)


def tables(path: str) -> list[str]:
    with connect(path) as con:
        return [r[0] for r in con.execute("select name from sqlite_master where type in ('table', 'view') and name not like 'sqlite!_%' escape '!' order by name")]


def pick_table(path: str, name: str | None) -> str:
    """The named table, whatever its case, or the only one."""
    found = tables(path)
    if not found:
        raise EngineError(errors.NO_TABLES, f"No tables in SQLite file {path}")
    if name is None:
        if len(found) > 1:
            raise EngineError(errors.TABLE_AMBIGUOUS, f"SQLite file {path} has several tables, name one as {path}:::<table>: {', '.join(found)}")
        return found[0]
    match = [t for t in found if t.lower() == name.lower()]
    if not match:
        raise EngineError(errors.TABLE_MISSING, f"Table {name} is not in SQLite file {path}; it has {', '.join(found)}")
    return match[0]


def affinity(declared: str) -> T.DataType:
    """SQLite's rules for a declared type; anything numeric but not integer is double."""
    d = (declared or "").upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if not d or "BLOB" in d:
        return T.BinaryType() if "BLOB" in d else T.StringType()
    return T.DoubleType()


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def schema_of(path: str, table: str) -> T.StructType:
    """Each column's type by its declaration, widened to what its values are: any of them may be of any type in SQLite.

    Reals in an integer column make it double, texts make it text, and blobs
    beside anything else make it binary, so that no value is lost. One scan
    inside SQLite tells.
    """
    with connect(path) as con:
        declared = [(r[1], affinity(r[2])) for r in con.execute(f"pragma table_info({quoted(table)})")]
        if not declared:
            return T.StructType([])
        kinds = ", ".join(f"max(typeof({quoted(n)}) = '{k}')" for n, _ in declared for k in ("real", "text", "blob"))
        found = con.execute(f"select {kinds} from {quoted(table)}").fetchone()
    fields = []
    for i, (name, kind) in enumerate(declared):
        real, text, blob = found[3 * i : 3 * i + 3]
        if blob:
            kind = T.BinaryType()
        elif text and not isinstance(kind, T.BinaryType):
            kind = T.StringType()
        elif real and isinstance(kind, T.LongType):
            kind = T.DoubleType()
        fields.append(T.StructField(name, kind))
    return T.StructType(fields)


@dataclass
class RowRange(ds.InputPartition):
    low: int | None
    high: int | None


def coerced(value, kind: T.DataType):  # noqa: ANN001, ANN201
    """A value of a dynamically typed column in the column's one type, which schema_of() has made wide enough."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    if isinstance(kind, T.BinaryType):
        return value if isinstance(value, bytes) else str(value).encode()
    return float(value) if isinstance(kind, T.DoubleType) else int(value)


class SqliteReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema_, self.path, self.table = schema, options["path"], options["table"]
        self.where: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        known = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
        kinds = {f.name: f.dataType for f in self.schema_.fields}
        for f in filters:
            op = known.get(type(f))
            if op and len(f.attribute) == 1 and isinstance(kinds.get(f.attribute[0]), (T.LongType, T.DoubleType)) and isinstance(f.value, (int, float)):
                self.where.append((f"{quoted(f.attribute[0])} {op} ?", f.value))
            yield f  # checked again by Spark, as SQLite's types are dynamic

    def partitions(self) -> list[ds.InputPartition]:
        with connect(self.path) as con:
            try:
                # every SPLIT_ROWS-th rowid, so ranges hold as many rows however the rowids lie
                numbered = f"select rowid as r, row_number() over (order by rowid) as k from {quoted(self.table)}"
                starts = [r[0] for r in con.execute(f"select r from ({numbered}) where (k - 1) % {SPLIT_ROWS} = 0 order by r")]
            except sqlite3.Error:  # views and tables without rowid
                return [RowRange(None, None)]
        if not starts:
            return [RowRange(None, None)]
        return [RowRange(a, z) for a, z in zip(starts, [*(x - 1 for x in starts[1:]), (1 << 63) - 1], strict=True)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        kinds = [f.dataType for f in self.schema_.fields]
        arrow = [{"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}.get(k.simpleString(), pa.string()) for k in kinds]
        where, values = [w for w, _ in self.where], [v for _, v in self.where]
        if partition.low is not None:
            where.append("rowid between ? and ?")
            values += [partition.low, partition.high]
        with connect(self.path) as con:
            con.text_factory = lambda b: b.decode("utf-8", "replace")
            rows = con.execute(f"select {', '.join(quoted(f.name) for f in self.schema_.fields)} from {quoted(self.table)}" + (" where " + " and ".join(where) if where else ""), values)
            while chunk := rows.fetchmany(BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([coerced(v, k) for v in c], a) for c, k, a in zip(zip(*chunk, strict=True), kinds, arrow, strict=True)], [f.name for f in self.schema_.fields])


class SqliteSource(ds.DataSource):
    """Options: path, table. The file must be where executors can open it."""

    @classmethod
    def name(cls) -> str:
        return "textloom_sqlite"

    def schema(self) -> T.StructType:
        return schema_of(self.options["path"], self.options["table"])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


def read(spark: SparkSession, path: str, table: str):  # noqa: ANN201
    from textloom.ship import ship

    ship(spark)
    spark.dataSource.register(SqliteSource)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("textloom_sqlite").option("table", table).load(path)
