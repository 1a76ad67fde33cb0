import io
import json
import os
import sqlite3

import pytest

from textloom import errors
from textloom.engine import Engine, table_name
from textloom.errors import EngineError
from textloom.options import ReadOptions
from textloom.sources import cache
from textloom.streaming.follow import follow
from textloom.sources.infer import Schema


@pytest.fixture
def numbers(tmp_path):
    path = tmp_path / "n.txt"
    path.write_text("".join(f"{i} x{i % 3}\n" for i in range(1, 101)))
    return str(path)


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "one.sqlite")
    with sqlite3.connect(path) as con:
        con.execute("create table My_Table (x int, y real, z text, b blob, n numeric)")
        con.executemany("insert into My_Table values (?, ?, ?, ?, ?)", [(i, i / 2, f"t{i}", b"\x01", i) for i in range(100)])
    con.close()
    return path


def rows(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


def code(engine, sql, **kw):
    r = engine.execute(sql, **kw)
    if r.error:
        return r.error.code
    try:
        r.rows()
    except EngineError as e:
        return e.code
    return 0


def test_group_and_join(spark, numbers):
    e = Engine(spark)
    assert rows(e, f"select c2, sum(c1) s from {numbers} group by c2 order by s desc") == [("x1", 1717), ("x0", 1683), ("x2", 1650)]
    assert rows(e, f"select count(*) from {numbers} a join {numbers} b on a.c1 = b.c1 + 1") == [(99,)]
    assert len(e.tables) == 1


def test_result_names(spark, numbers):
    assert Engine(spark).sql(f"select count(*), max(c1) m, c2||'x' from {numbers} group by c2").columns == ["count(*)", "m", "c2||'x'"]


def test_envelope(spark, numbers):
    e = Engine(spark)
    r = e.execute(f"select count(*) from {numbers}")
    assert (r.status, r.rows(), list(r.new_tables)) == ("ok", [(100,)], [numbers])
    again = e.execute(f"select max(c1) from {numbers}")
    assert again.new_tables == {}
    assert list(again.tables) == [numbers]
    bad = e.execute("select * from /no/such/file")
    assert (bad.status, bad.error.code) == ("error", errors.FILE_MISSING)


@pytest.mark.parametrize(("sql", "want"), [("select nothing from {}", errors.SQL), ("select * from", errors.NO_TABLE), ("drop table x", errors.SQL), ("select c1 from {} union all select c1, c2 from {}", errors.SQL)])
def test_codes(spark, numbers, sql, want):
    assert code(Engine(spark), sql.format(numbers, numbers)) == want
    assert code(Engine(spark), b"select 1") == errors.NOT_UNICODE


def test_streams(spark):
    e = Engine(spark, streams={"feed": io.StringIO("1 a\n2 b\n3 c\n"), "-": io.BytesIO(b"2\n3\n")})
    assert rows(e, "select count(*), max(f.c2) from feed f join - s on f.c1 = s.c1") == [(2, "c")]
    assert code(Engine(spark, ReadOptions(gzipped=True), {"-": io.BytesIO(b"\x1f\x8b")}), "select * from -") == errors.GZ_STDIN


def test_two_dialects(spark, tmp_path, numbers):
    other = tmp_path / "o.csv"
    other.write_text("k,v\n1,one\n2,two\n")
    e = Engine(spark)
    e.load(str(other), delimiter=",", header=True)
    assert rows(e, f"select v from {numbers} n join {other} o on n.c1 = o.k order by v") == [("one",), ("two",)]


def test_sqlite(spark, database, tmp_path):
    e = Engine(spark)
    assert e.load(database).columns == [("x", "int"), ("y", "real"), ("z", "text"), ("b", "blob"), ("n", "real")]
    assert rows(e, f"select count(*), sum(x) from {database}:::my_table where x >= 98") == [(2, 197)]
    assert code(e, f"select * from {database}:::nope") == errors.TABLE_MISSING
    with sqlite3.connect(str(tmp_path / "two.db")) as con:
        con.execute("create table a (x)")
        con.execute("create table b (x)")
    assert code(e, f"select * from {tmp_path}/two.db") == errors.TABLE_AMBIGUOUS
    with sqlite3.connect(str(tmp_path / "none.db")) as con:
        con.execute("create table a (x)")
        con.execute("drop table a")
    assert code(e, f"select * from {tmp_path}/none.db") == errors.NO_TABLES
    (tmp_path / "text").write_text("x\n")
    assert code(e, f"select * from {tmp_path}/text:::a") == errors.UNKNOWN_TYPE


def test_filter_reaches_sqlite(spark, database):
    plan = Engine(spark).sql(f"select z from {database} where x > 97")._jdf.queryExecution().toString()
    assert "BatchScan" in plan or "textloom_sqlite" in plan


def test_save(spark, numbers, tmp_path):
    target = str(tmp_path / "out.sqlite")
    e = Engine(spark)
    text = e.save(f"select * from {numbers} a join {numbers} b on a.c1 = b.c1", target)
    with sqlite3.connect(target) as con:
        assert con.execute("select count(*), sum(c1) from n_dot_txt").fetchone() == (100, 5050)
        assert con.execute(text.replace("D", "")).fetchone() is not None
    with pytest.raises(EngineError) as err:
        e.save(f"select * from {numbers}", target)
    assert err.value.code == errors.TARGET_EXISTS
    Engine(spark).save(f"select * from {numbers}", str(tmp_path / "folder") + "/")
    assert spark.read.parquet(str(tmp_path / "folder/n_dot_txt.parquet")).count() == 100


def test_cache(spark, numbers):
    write, read = ReadOptions(cache="readwrite"), ReadOptions(cache="read")
    assert Engine(spark, write).load(numbers).frame.count() == 100
    folder = numbers + cache.SUFFIX
    assert json.load(open(f"{folder}/{cache.SIGNATURE}"))["size"] == os.path.getsize(numbers)
    info = Engine(spark, read).load(numbers)
    assert info.source_type == "cache-file-with-original"
    assert info.frame.count() == 100
    assert Engine(spark).load(numbers).source_type == "file-with-unused-cache"
    assert rows(Engine(spark), f"select max(c1) from {folder}") == [(100,)]
    assert code(Engine(spark, read.merged(delimiter=",")), f"select * from {numbers}") == errors.CACHE_DIFFERS
    with open(numbers, "a") as f:
        f.write("101 x\n")
    assert code(Engine(spark, read), f"select * from {numbers}") == errors.CACHE_DIFFERS
    assert Engine(spark, write.merged(overwrite_cache=True)).load(numbers).frame.count() == 101
    assert rows(Engine(spark, read), f"select max(c1) from {numbers}") == [(101,)]
    assert code(Engine(spark), f"select * from {folder}:::nope") == errors.CACHE_TABLE_MISSING
    os.rename(numbers, numbers + ".gone")
    assert Engine(spark).load(folder).source_type == "cache-file"


def test_isolation_and_functions(spark, numbers):
    a, b = Engine(spark), Engine(spark)
    a.load(numbers)
    assert b.tables == {}
    b.register_function("twice", lambda args: f"(({args[0]}) * 2)")
    assert rows(b, f"select twice(max(c1)) from {numbers}") == [(200,)]


def test_plain_spark_sql(spark, numbers):
    e = Engine(spark, compat=False)
    assert rows(e, f"select count(*) from {numbers} where c2 like 'X%'") == [(0,)]
    assert rows(Engine(spark), f"select count(*) from {numbers} where c2 like 'X%'") == [(100,)]


@pytest.mark.parametrize(("path", "name"), [("/x/1-a.csv", "t_1_dash_a_dot_csv"), ("/x/a.sqlite", "a"), ("a b+c?.d", "a_space_b_plus_c_qm__dot_d")])
def test_table_names(path, name):
    assert table_name(path) == name


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ("substr('hello', 0, 3)", "he"),
        ("substr('hello', -3, 2)", "ll"),
        ("substr('hello', 2)", "ello"),
        ("iif(1 = 1, 'a', 'b')", "a"),
        ("max(1, null)", None),
        ("min(3, 2)", 2),
        ("printf('%05d %.2f %s', 42, 1.5, 'x')", "00042 1.50 x"),
        ("'abc' glob 'a*'", True),
        ("typeof(1.5)", "real"),
        ("typeof(null)", "null"),
        ("strftime('%Y-%m', '2020-03-04 05:06:07')", "2020-03"),
        ("strftime('%s', '1970-01-02')", "86400"),
        ("datetime(3600, 'unixepoch')", "1970-01-01 01:00:00"),
        ("date('2020-01-31', 'start of month', '+1 month')", "2020-02-01"),
        ("time('2020-01-01 10:00:00', '-05:00')", "05:00:00"),
        ("julianday('2000-01-01 12:00:00')", 2451545.0),
        ("unixepoch('1970-01-01 00:01:00')", 60),
        ("date('nonsense')", None),
        ("1 / 0", None),
        ("json_extract('{\"a\": {\"b\": 5}}', '$.a.b')", "5"),
        ("json_valid('{}')", 1),
        ("json_array(1, 2)", "[1,2]"),
        ("log(100)", 2.0),
        ("unicode('A')", 65),
        ("char(65, 66)", "AB"),
        ("quote('a''b')", "'a''b'"),
        ("trunc(3.9)", 3.0),
        ("ifnull(null, 2)", 2),
        ("x'4142'", "AB"),
        ("likely(5)", 5),
        ("trim('xxaxx', 'x')", "a"),
        ("regexp('^a.c$', 'abc')", 1),
        ("regexp('a', null)", 0),
        ("regexp_extract('(?P<n>b)(c)', 'abcd', 0)", "b"),
        ("regexp_extract('(z)', 'abcd', 0)", None),
        ("sha('a', 1, 'utf-8')", "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"),
        ("sha('a', 386, 'utf-8') = sha2('a', 384)", True),
        ("sha1('a')", "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8"),
    ],
)
def test_dialect(spark, expr, want):
    got = Engine(spark).sql(f"select {expr} v").first()[0]
    assert got == want


PATHS = [".bashrc", "/x/..y", "a.tar.gz", "//a", "dir/", "...", "", "/a/b.c", "a", "/", "x/.y.z", "a.b/c"]


def test_path_functions(spark):
    e = Engine(spark)
    for p in PATHS:
        got = e.sql(f"select file_folder('{p}') a, file_basename('{p}') b, file_ext('{p}') c, file_basename_no_ext('{p}') d").first()
        base = os.path.split(p)[1]
        ext = os.path.splitext(p)[1]
        assert tuple(got) == (os.path.split(p)[0], base, ext, base[: len(base) - len(ext)]), p


def test_aggregates(spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_text("".join(f"{i}\n" for i in (5, 1, 4, 2, 3)))
    e = Engine(spark)
    got = e.sql(f"select percentile(c1, 0.25), stddev_pop(c1), stddev_sample(c1), total(c1), group_concat(c1, '-') from {path}").first()
    assert got[0] == 2.0
    assert got[1] == pytest.approx(2**0.5)
    assert got[2] == pytest.approx(2.5**0.5)
    assert got[3] == 15.0
    assert sorted(got[4].split("-")) == list("12345")
    assert e.sql(f"select stddev_pop(c1) from {path} where c1 = 1").first()[0] is None
    assert e.sql(f"select percentile(c1, 2) from {path}").first()[0] is None


def test_follow(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text("1 x\n2 y\n")
    stream = follow(spark, str(tmp_path / "in"), Schema(["k", "v"], ["int", "text"]))
    q = stream.writeStream.format("memory").queryName("followed").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.sql("select * from followed").collect())) == [(1, "x"), (2, "y")]
    finally:
        q.stop()


def test_saved_rows_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    """Each task writes its own part; order, types, nulls and rows of all partitions stay, the parts go."""
    from pyspark.sql.classic.dataframe import DataFrame

    from textloom.operators import sinks

    df = spark.range(0, 23_000, 1, 7).where("id < 6000 or id > 12000").selectExpr("id", "cast(id as string) || ' é\\'\"' as `a \"b`", "if(id % 3 = 0, null, id / 4) as x", "id % 2 = 0 as even", "cast(cast(id as string) as binary) as raw", "cast(id as decimal(9, 2)) as d", "if(id = 5, cast('NaN' as double), 1d) as nan", "cast(x'ff41' as string) as odd", "array(id) as list")
    brought, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: brought.append(collect(self)) or brought[-1])
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_, **__: pytest.fail("rows came to the driver"))
    sinks.save_tables({"t \"1\"": df, "none": df.where("id < 0")}, str(tmp_path / "o.db"))
    assert sum(map(len, brought)) <= 7
    monkeypatch.undo()
    with sqlite3.connect(str(tmp_path / "o.db")) as con:
        got = con.execute('select * from "t ""1""" order by rowid').fetchall()
        assert con.execute("select count(*) from none").fetchone() == (0,)
        assert [r[2] for r in con.execute("pragma table_info(none)")] == ["INT", "TEXT", "REAL", "INT", "BLOB", "TEXT", "REAL", "TEXT", "TEXT"]
    assert got == [(i, f"{i} é'\"", None if i % 3 == 0 else i / 4, int(i % 2 == 0), str(i).encode(), f"{i}.00", None if i == 5 else 1.0, "�A", f"[{i}]") for i in range(23_000) if i < 6000 or i > 12000]
    assert [f.name for f in tmp_path.iterdir()] == ["o.db"]


def test_saved_rows_stream_where_no_folder_is_shared(spark, tmp_path, monkeypatch):
    from textloom.operators import sinks

    monkeypatch.setattr(sinks, "_parts_folder", lambda *_: None)
    sinks.save_tables({"t": spark.range(0, 12_000, 1, 3).selectExpr("id", "cast(x'ff41' as string) as odd")}, str(tmp_path / "o.db"))
    with sqlite3.connect(str(tmp_path / "o.db")) as con:
        assert con.execute("select * from t order by rowid").fetchall() == [(i, "�A") for i in range(12_000)]
