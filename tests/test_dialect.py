"""Texts in the dialect, run by SQLite itself and by the engine: the same rows."""

import random
import re
import sqlite3

import pytest

from textloom.engine import Engine
from textloom.errors import EngineError
from textloom.operators import sqltext

COLUMNS = "id integer, k integer, x real, s text, n integer, w text"


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    rng = random.Random(2)
    rows = [(i, 1 + i // 6, rng.choice([None, 1.5, 2.25, 4.0]), rng.choice("abcd"), rng.randrange(10), rng.choice(["12abc", "7", "x", None, "1e2", " 5.5", "1?a"])) for i in range(18)]
    con = sqlite3.connect(":memory:")
    con.execute(f"create table t ({COLUMNS})")
    con.executemany("insert into t values (?, ?, ?, ?, ?, ?)", rows)
    con.create_function("regexp", 2, lambda p, x: 0 if x is None else int(bool(re.search(p, x))))
    path = f"{tmp_path_factory.mktemp('dialect')}/t.parquet"
    spark.createDataFrame(rows, "id long, k long, x double, s string, n long, w string").coalesce(1).write.parquet(path)
    return con, Engine(spark), path


def same(both, text):
    con, engine, path = both

    def plain(rows):
        # truth values are 0 and 1, and reals that are integers count as reals alike
        return sorted((tuple(None if v is None else v if isinstance(v, str) else (isinstance(v, float), round(float(v), 9)) for v in r) for r in rows), key=repr)

    want = con.execute(text.format(t="t")).fetchall()
    got = [tuple(r) for r in engine.sql(text.format(t=path)).collect()]
    assert plain(got) == plain(want)


TEXTS = [
    "select 7/2 as a, -7/2 as b, 7/2.0 as c, 1+40/6 as d, 7/0 as e, 9/2/2 as f, 9/(2.0/2) as g",
    "select id, n/3 as a, x/2 as b, (n+1)/2/2 as c, x/n/2 as d, sum(n) over ()/4 as g from {t}",
    "select k, sum(n)/count(*) as a, round(avg(x)/2, 6) as b, round(sum(x)/3, 2) as c from {t} group by k",
    "select id from {t} where n/2 = 2",
    "select case when n/2 > 1 then n/3 else n/4 end as z from {t}",
    "select id from {t} order by n/2, id limit 3",
    "with q as (select n/4 as h from {t}) select h, count(*) as c from q group by h",
    "select (select max(n)/2 from {t}) as z",
    "select max(n) as m, min(id)/2 as z from {t}",
    "select k, max(id) as m, s from {t} group by k",
    "select s, max(id) as m from {t}",
    "select upper(s)||n as u, min(id) as m from {t}",
    "select t.s, t.n, max(id) as m from {t} t group by k",
    "select k, s, max(id) as m from {t} group by k order by n limit 2",
    "select k, max(id), s from {t} where n > 2 group by k having s <> 'zzz'",
    "select * from (select k, max(id) as m, s from {t} group by k) z where m > 6",
    "select id, s regexp '[ab]' as a, w regexp '^1' as b, not w regexp 'x' as c from {t}",
    "select id from {t} where w regexp '^1' or s regexp 'd'",
    "select id from {t} where w not regexp '^1'",
    "select id from {t} where s || 'z' regexp '^a' || 'z' and n > 1",
    "select id, s||'x' glob '[ab]*' as g, w glob s||'*' as h, w glob '1' || '?a*' as i from {t}",
    "select id from {t} where w not glob '*[0-9]' and n > 3",
    "select id from {t} where w glob '1?a*'",
    "select glob('a*', s) as a, like('A', s) as b from {t}",
    "select id from {t} where n",
    "select id from {t} where n and x > 2",
    "select id from {t} where x > 2 or n",
    "select id from {t} where regexp('a', s) and n between 1 and 5",
    "select id from {t} where not n",
    "select k, sum(s = 'a') as z, sum(n > 4) as y from {t} group by k",
    "select id, cast(w as integer) as a, cast(w as real) as b, cast(x as int) as c, cast(n as text) as d from {t}",
    "select id, total(n) over (partition by k) as a from {t}",
    "select z.id, round(avg(z.x) over (partition by z.k order by z.n groups between 1 preceding and current row), 4) as a, row_number() over (order by z.id) as r from {t} z where z.n > 1 order by z.id limit 5",
    "select id, sum(n) over w as a, count(x) over w as b from {t} window w as (order by k groups between 1 preceding and current row)",
    "select id, sum(n) over (order by k groups current row) as a from {t} union all select 99, 5 order by a, id",
    "select * from (select *, sum(n) over (order by k groups between current row and 1 following) as q from {t}) y where q > 20",
]
BOUNDS = ["between 1 preceding and current row", "between 1 preceding and 1 following", "between unbounded preceding and 1 following", "between 1 following and 2 following", "2 preceding"]
FRAMES = [f"groups {b}" for b in BOUNDS] + ["rows between unbounded preceding and unbounded following", "range between unbounded preceding and current row", "range between 2 preceding and 1 following", "rows between 1 preceding and 2 following"]


@pytest.mark.parametrize("text", TEXTS)
def test_texts(both, text):
    same(both, text)


@pytest.mark.parametrize("exclude", ["", "exclude no others", "exclude current row", "exclude group", "exclude ties"])
@pytest.mark.parametrize("frame", FRAMES)
def test_frames(both, frame, exclude):
    # an order without ties where a frame of rows would be ambiguous
    over = f"over (partition by k order by {'id' if frame.startswith('rows') else 'n'} {frame} {exclude})"
    calls = ["sum(n)", "count(*)", "avg(x)", "count(x)", "sum(x)", "total(x)"]
    if frame.startswith("groups") or "exclude" not in exclude or exclude == "exclude no others" or "unbounded preceding and current" in frame or (frame.startswith("rows") and exclude == "exclude current row"):
        calls += ["min(x)", "max(n)"]
    same(both, "select id, " + ", ".join(f"{c} {over} as c{i}" for i, c in enumerate(calls)) + " from {t}")


def test_what_frames_do_not_take_is_named(both):
    _, engine, path = both
    for text in (f"select k, count(*) as c, sum(count(*)) over (order by k groups current row) as s from {path} group by k", f"select min(n) over (order by n rows 1 preceding exclude ties) as m from {path}"):
        with pytest.raises(EngineError, match="not supported"):
            engine.sql(text)


def test_decimals_are_divided_as_reals(spark, tmp_path):
    path = f"{tmp_path}/d.parquet"
    spark.sql("select cast(7 as decimal(10, 2)) as d, 7L as n").write.parquet(path)
    row = Engine(spark).sql(f"select d / 2 as a, n / 2 as b, d / n as c, sum(d) / 2 as s from {path} group by d, n").first()
    assert (float(row["a"]), row["b"], float(row["c"]), float(row["s"])) == (3.5, 3, 1.0, 3.5)


def test_an_unknown_column_is_still_an_error(both):
    _, engine, path = both
    for text in (f"select nothing, max(id) as m from {path}", f"select id / nothing as z from {path}", f"select id from {path} where nothing"):
        result = engine.execute(text)
        assert result.status == "error"


def test_spark_sql_stays_as_it_is_without_the_dialect(spark, both):
    assert Engine(spark, compat=False).sql("select 7 / 2 as a").first()["a"] == 3.5


@pytest.mark.parametrize(("text", "want"), [("a regexp 'x'", "(regexp('x', a) = 1)"), ("b.a || 'c' not regexp f(x) and d", "(NOT (regexp(f(x), b.a || 'c') = 1)) and d"), ("regexp('a', b)", "regexp('a', b)")])
def test_infix_operands(text, want):
    assert sqltext._infix(text) == want
