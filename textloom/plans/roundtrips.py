"""Queries through the library's own sources and sinks, each with the table itself as its answer.

A table is written in some form and read back by name through the engine, so
what comes out must be what DuckDB reads from the Parquet. Files go to the
folder that the session names in spark.checkpoint.dir, which executors share;
where none is named (local runs) to a temporary one.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.engine import Engine
from textloom.operators import sinks
from textloom.options import ReadOptions, WriteOptions

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
ORDERS_SQL = f"select {ORDERS} from orders"
READ_BACK = "select c1 as o_orderkey, c2 as o_custkey, c3 as o_orderstatus, c4 as o_totalprice, c5 as o_orderpriority from {}"


def _folder(spark: SparkSession) -> str:
    to = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not to:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        to = tempfile.mkdtemp(prefix="textloom-")
    to = f"{to.rstrip('/')}/roundtrip-{uuid.uuid4().hex}"
    if "://" not in to or to.startswith("file://"):
        os.makedirs(to.removeprefix("file://"), exist_ok=True)
    return to.removeprefix("file://") if to.startswith("file://") else to


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(*ORDERS.split(", "))


def _text(delimiter: str, compression: str = "none", quoting: str = "minimal"):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        to = _folder(spark) + "/orders"
        sinks.write_delimited(_orders(spark, sf_dir), to, WriteOptions(delimiter=delimiter, quoting=quoting), compression)
        return Engine(spark, ReadOptions(delimiter=delimiter)).sql(READ_BACK.format(f"{to}/part-*"))

    return run


def headed_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = _folder(spark) + "/orders"
    _orders(spark, sf_dir).repartition(5).write.csv(to, header=True)
    return Engine(spark, ReadOptions(delimiter=",", header=True)).sql(f"select * from {to}/part-*")


def quoted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, delimiters and line ends inside values: the record reader."""
    to = _folder(spark) + "/nation"
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.concat(F.lit('say "'), "n_name", F.lit('", then\nstop')).alias("n_name"))
    sinks.write_delimited(rows, to, WriteOptions(delimiter=","))
    return Engine(spark, ReadOptions(delimiter=",")).sql(f"select c1 as n_nationkey, c2 as n_name from {to}/part-*")


def ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of blanks between fields, short rows padded, long ones folded into the last column."""
    to = _folder(spark) + "/ragged"
    n = F.col("n_nationkey")
    line = F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit("   "), "n_name")).when(n % 3 == 1, F.concat(n.cast("string"), F.lit(" "), "n_name", F.lit("    x  y"))).otherwise(F.concat(F.lit("  "), n.cast("string"), F.lit(" "), "n_name", F.lit(" z")))
    spark.read.parquet(f"{sf_dir}/nation.parquet").select(line.alias("value")).write.text(to)
    return Engine(spark, ReadOptions(columns=3)).sql(f"select c1 as k, c2 as name, c3 as tail from {to}/part-*")


RAGGED_SQL = "select cast(n_nationkey as bigint) as k, n_name as name, case n_nationkey % 3 when 0 then null when 1 then 'x y' else 'z' end as tail from nation"


def sqlite_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved to a SQLite file, then read by ranges of rowid."""
    to = _folder(spark) + "/saved.sqlite"
    sinks.save_tables({"orders": _orders(spark, sf_dir)}, to)
    return Engine(spark).sql(f"select * from {to}:::orders")


def sqlite_join_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQLite table, a delimited file and a Parquet file in one query."""
    to = _folder(spark)
    sinks.save_tables({"region": spark.read.parquet(f"{sf_dir}/region.parquet")}, f"{to}/one.db")
    sinks.write_delimited(spark.read.parquet(f"{sf_dir}/nation.parquet"), f"{to}/nation", WriteOptions(delimiter="|"))
    engine = Engine(spark, ReadOptions(delimiter="|"))
    return engine.sql(f"select r.r_name, count(*) as n from {to}/one.db r join {to}/nation/part-* n on n.c3 = r.r_regionkey join {sf_dir}/customer.parquet c on c.c_nationkey = n.c1 group by r.r_name")


def cached_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read once with a cache written beside the file, then again from the cache alone."""
    to = _folder(spark) + "/orders"
    sinks.write_delimited(_orders(spark, sf_dir).coalesce(1), to, WriteOptions(delimiter="\t"))
    part = next(os.path.join(to, f) for f in os.listdir(to) if f.startswith("part-"))
    options = ReadOptions(delimiter="\t", cache="readwrite")
    Engine(spark, options).load(part)
    engine = Engine(spark, options.merged(cache="read"))
    assert engine.load(part).source_type == "cache-file-with-original"
    return engine.sql(READ_BACK.format(part))


def late_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the first 120 rows, more than a sample, and texts after them: a column's type comes from all rows, and no value is lost."""
    to = _folder(spark) + "/late"
    value = F.when(F.col("c_custkey") < 120, F.col("c_custkey").cast("string")).otherwise(F.col("c_name"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").orderBy("c_custkey").coalesce(1).select(value.alias("v"), "c_custkey")
    sinks.write_delimited(rows, to, WriteOptions(delimiter=","))
    return Engine(spark, ReadOptions(delimiter=",")).sql(f"select c1 as v, c2 as k from {to}/part-*")


def sqlite_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reals and texts in columns declared as integers, and rowids far apart."""
    import sqlite3

    to = _folder(spark) + "/odd.db"
    with sqlite3.connect(to) as con:
        con.execute("create table t (a integer, b integer, c text)")
        con.executemany("insert into t (rowid, a, b, c) values (?, ?, ?, ?)", [(1, 1, 1, "x"), (5, 5.5, "y", 7), (9 * 10**18, None, 3, None)])
    return Engine(spark).sql(f"select a, b, c from {to}:::t")


def quoted_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of quoted values with line ends in them, read in many splits."""
    to = _folder(spark) + "/blocks"
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").coalesce(1).select("s_suppkey", F.concat(F.lit('a "quoted",\n'), "s_name", F.lit("\nvalue\n")).alias("v"))
    sinks.write_delimited(rows, to, WriteOptions(delimiter=","))
    engine = Engine(spark, ReadOptions(delimiter=","))
    engine.spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    return engine.sql(f"select c1 as s_suppkey, c2 as v from {to}/part-*")


def data_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded stream joined with itself under its registered name."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect()  # 25 rows by definition
    text = "k,r\n" + "".join(f"{a},{b}\n" for a, b in rows)
    engine = Engine(spark, ReadOptions(delimiter=",", header=True), {"feed": io.StringIO(text)})
    return engine.sql("select a.k, count(*) as n from feed a join feed b on a.r = b.r group by a.k")


def own_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialect's functions with its own argument orders and rules for nulls, through SQL over a file name."""
    none = "nullif(n_name, 'NATION_3')"
    return Engine(spark).sql(
        f"select n_nationkey, regexp('_[0-4]$', n_name) as hit, regexp('N', {none}) as some, regexp_extract('([A-Za-z]+)_?(.*)', n_name, 1) as part, md5(n_name, 'utf-8') as m, sha1(n_name) as s1, sha(n_name, 1, 'utf-8') as s0, sha(n_name, 256, 'utf-8') as s2, length(sha(n_name, 224, 'utf-8')) + length(sha(n_name, 384, 'utf-8')) + length(sha(n_name, 512, 'utf-8')) as l, power(n_nationkey, 2) as p, round(sqrt(n_nationkey), 9) as q from {sf_dir}/nation.parquet"
    )


OWN_FUNCTIONS_SQL = r"select n_nationkey, cast(regexp_matches(n_name, '_[0-4]$') as int) as hit, cast(n_name <> 'NATION_3' as int) as some, case when regexp_matches(n_name, '([A-Za-z]+)_?(.*)') then regexp_extract(n_name, '([A-Za-z]+)_?(.*)', 2) end as part, md5(n_name) as m, sha1(n_name) as s1, sha1(n_name) as s0, sha256(n_name) as s2, 56 + 96 + 128 as l, power(cast(n_nationkey as double), 2) as p, round(sqrt(n_nationkey), 9) as q from nation"


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path functions, in SQL over a file name."""
    path = f"{sf_dir}/pages.parquet"
    return Engine(spark).sql(
        f"select page_id, file_folder(u) as folder, file_basename(u) as base, file_ext(u) as ext, file_basename_no_ext(u) as bare from (select page_id, url || iif(page_id % 2 = 0, '/a.tar.gz', '') as u from {path}) x"
    )


FILE_NAMES_SQL = r"""
select page_id, case when regexp_matches(head, '^/*$') then head else rtrim(head, '/') end as folder, base, ext, substring(base, 1, length(base) - length(ext)) as bare
from (select page_id, regexp_extract(u, '^(.*/)', 1) as head, regexp_extract(u, '([^/]*)$', 1) as base, regexp_extract(u, '(?:^|/)\.*[^./][^/]*?(\.[^./]*)$', 1) as ext
      from (select page_id, url || case when page_id % 2 = 0 then '/a.tar.gz' else '' end as u from pages))"""


def dialect_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQLite's ways of writing: GLOB, LIKE without case, substr from 0, printf, group_concat, total, two-argument max."""
    return Engine(spark).sql(
        f"select n_regionkey, count(*) as n, total(case when n_name glob '*[0-4]' then n_nationkey end) as t, max(max(n_nationkey, 5)) as m, min(substr(n_name, 0, 4)) as s, min(printf('%03d', n_nationkey)) as p, sum(iif(n_name like 'NATION%', 1, 0)) as l from {sf_dir}/nation.parquet group by n_regionkey"
    )


DIALECT_WAYS_SQL = "select n_regionkey, count(*) as n, coalesce(cast(sum(case when regexp_matches(n_name, '[0-4]$') then n_nationkey end) as double), 0) as t, max(greatest(n_nationkey, 5)) as m, min(substr(n_name, 1, 3)) as s, min(printf('%03d', n_nationkey)) as p, cast(sum(case when n_name ilike 'nation%' then 1 else 0 end) as bigint) as l from nation group by n_regionkey"

QUERIES = {
    "text_roundtrip": _text(","),
    "text_quote_all_roundtrip": _text("\t", quoting="all"),
    "gzip_roundtrip": _text("|", "gzip"),
    "glob_roundtrip": headed_glob,
    "quoted_roundtrip": quoted_values,
    "ragged_rows": ragged_rows,
    "sqlite_roundtrip": sqlite_file,
    "sqlite_join_text": sqlite_join_text,
    "cache_roundtrip": cached_text,
    "late_misfits": late_misfits,
    "sqlite_misfits": sqlite_misfits,
    "quoted_blocks": quoted_blocks,
    "data_stream": data_stream,
    "own_functions": own_functions,
    "file_names": file_names,
    "dialect_ways": dialect_ways,
}
ORACLE_SQL = {
    "text_roundtrip": ORDERS_SQL,
    "text_quote_all_roundtrip": ORDERS_SQL,
    "gzip_roundtrip": ORDERS_SQL,
    "glob_roundtrip": ORDERS_SQL,
    "quoted_roundtrip": "select cast(n_nationkey as bigint) as n_nationkey, 'say \"' || n_name || '\", then' || chr(10) || 'stop' as n_name from nation",
    "ragged_rows": RAGGED_SQL,
    "sqlite_roundtrip": ORDERS_SQL,
    "sqlite_join_text": "select r_name, count(*) as n from region r join nation n on n.n_regionkey = r.r_regionkey join customer c on c.c_nationkey = n.n_nationkey group by r_name",
    "cache_roundtrip": ORDERS_SQL,
    "late_misfits": "select case when c_custkey < 120 then cast(c_custkey as varchar) else c_name end as v, c_custkey as k from customer",
    "sqlite_misfits": "select a, b, c from (values (1.0::double, '1', 'x'), (5.5, 'y', '7'), (null, '3', null)) t(a, b, c)",
    "quoted_blocks": "select s_suppkey, 'a \"quoted\",' || chr(10) || s_name || chr(10) || 'value' || chr(10) as v from supplier",
    "data_stream": "select cast(a.n_nationkey as bigint) as k, count(*) as n from nation a join nation b on a.n_regionkey = b.n_regionkey group by a.n_nationkey",
    "own_functions": OWN_FUNCTIONS_SQL,
    "file_names": FILE_NAMES_SQL,
    "dialect_ways": DIALECT_WAYS_SQL,
}
