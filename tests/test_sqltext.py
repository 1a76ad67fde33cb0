import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from textloom import errors
from textloom.errors import EngineError
from textloom.operators import sqltext


def names(sql):
    return [r.name for r in sqltext.references(sql)]


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("select * from /tmp/a.csv", ["/tmp/a.csv"]),
        ("select * from ../x/*.gz a join - on a.c1 = 2", ["../x/*.gz", "-"]),
        ("select count(*) from a.db:::t where x in (select c1 from b.csv)", ["a.db:::t", "b.csv"]),
        ("select * from (select c1 from f1.csv union all select c1 from f2.csv) u", ["f1.csv", "f2.csv"]),
        ("select * from a.csv, b.csv where a.c1 = b.c1", ["a.csv", "b.csv"]),
        ("with t as (select 1), u(x) as (select * from f.csv) select * from t join u", ["f.csv"]),
        ("select extract(year from c1), trim(both 'x' from c2) from f", ["f"]),
        ("select ' from nowhere ' from f -- from comment\n", ["f"]),
        ("select 1 is distinct from 2, c1 is not distinct from c2 from f", ["f"]),
        ("select * from `my file.csv` x", ["my file.csv"]),
        ("select * from range(10)", []),
        ("select * from f left join g on f.c1 = g.c1 order by f.c1, g.c2", ["f", "g"]),
        ("select 1", []),
        ("select * from (a.csv x join b.csv y on x.c1 = y.c1)", ["a.csv", "b.csv"]),
    ],
)
def test_references(sql, want):
    assert names(sql) == want


@pytest.mark.parametrize("sql", ["select * from", "select * from where x = 1", "select * from a join on x"])
def test_from_without_table(sql):
    with pytest.raises(EngineError) as e:
        sqltext.references(sql)
    assert e.value.code == errors.NO_TABLE


@given(st.text(max_size=60))
def test_tokens_keep_all_text(text):
    assert sqltext.text_of(sqltext.tokens(text)) == text


@given(st.text(alphabet="abc '", max_size=12))
def test_literals_are_kept(text):
    literal = "'" + text.replace("'", "''") + "  from  x'"
    out, used = sqltext.with_tables(f"select {literal} from f", lambda n: "`v`")
    assert out == f"select {literal} from `v`"
    assert used == {"f": "`v`"}


def test_rewrite_calls_nested():
    table = {"f": lambda a: f"g({'; '.join(a)})"}
    assert sqltext.rewrite_calls("select f(f(1, 2), ')') from t.f", table) == "select g(g(1; 2); ')') from t.f"


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("select count(*), c1 from f", ["count(*)"]),
        ("select a.c1, sum(c2) s, max(c1) as m, 'x' from f", ["'x'"]),
        ("select * from f", []),
        ("select case when c1 = 1 then 2 end from f", ["case when c1 = 1 then 2 end"]),
        ("select distinct c1 + 1 from f", ["c1 + 1"]),
    ],
)
def test_name_columns(sql, want):
    assert re.findall(r"AS `([^`]*)`", sqltext.name_columns(sql)) == want


def test_operators():
    out = sqltext.rewrite_operators("select a like 'x', b glob '*.t?t', c is 1, d is not 2, x'0a', 1.5 from f limit 2, 3")
    assert "ILIKE 'x'" in out
    assert "RLIKE" in out
    assert "IS NOT DISTINCT FROM 1" in out
    assert "IS DISTINCT FROM 2" in out
    assert "CAST(X'0a' AS STRING)" in out
    assert "1.5D" in out
    assert out.endswith("LIMIT 3 OFFSET 2")


@pytest.mark.parametrize("sql", ["select 1", "with a as (select 1) select * from a", "(select 1)", "values (1)"])
def test_selects(sql):
    assert sqltext.is_select(sql)


@pytest.mark.parametrize("sql", ["drop table x", "insert into x select 1", "create view v as select 1", ""])
def test_other_statements(sql):
    assert not sqltext.is_select(sql)
