"""Counts over band joins against the joins themselves, and that no pairs are made for them."""

import math
import random

import pytest

from textloom.engine import Engine
from textloom.operators import bands
from textloom.plans import catalogue

NAN = float("nan")


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    """Values that repeat, lie on each other's bounds, are null, not a number or a negative zero; intervals that are empty or turned round."""
    draw = random.Random(5)
    some = lambda: draw.choice([None, NAN, -0.0, 0.0, math.inf, -math.inf, *range(-9, 10)])
    real = lambda x: None if x is None else float(x)
    folder = tmp_path_factory.mktemp("bands")
    a = [(i, i % 7, real(some()), real(some()), draw.randrange(-9, 10)) for i in range(150)]
    b = [(i, real(some()), real(some()), draw.randrange(-9, 10)) for i in range(200)]
    spark.createDataFrame(a, "k int, g int, lo double, hi double, w bigint").write.parquet(f"{folder}/a.parquet")
    spark.createDataFrame(b, "kb int, x double, y double, z int").write.parquet(f"{folder}/b.parquet")
    return f"{folder}/a.parquet", f"{folder}/b.parquet"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def rows(frame):
    return sorted(map(str, frame.collect()))


CONDITIONS = ["b.x between a.lo and a.hi", "b.x > a.lo and b.x <= a.hi", "a.lo < b.x and a.hi > b.x", "b.x >= a.lo - 2 and b.x < a.lo + 2", "b.x < a.hi", "b.x >= a.lo", "a.lo between b.x and b.y", "a.lo > b.x and b.y > a.lo", "b.x < a.lo and b.y >= a.lo", "z between w - 1 and w + 3", "z between w / 2 and w / 2 + 1", "w between b.x and b.x + 3", "b.x > w and b.y < w"]


@pytest.mark.parametrize("condition", CONDITIONS)
@pytest.mark.parametrize("query", ["select a.k, count(*) as n from {a} a join {b} b on {on} group by a.k", "select g, count(*) as n, count(hi) as m, min(lo) as lo, count(distinct w) as d from {a} a inner join {b} as b on {on} where k % 3 <> 1 group by g having n > 5 order by count(*) desc, g", "select count(*) as n, max(b.z) as z from {a} a join {b} b on {on}", "select kb as k from {b} b join {a} a on {on} group by kb"])
def test_counts_equal_the_join(spark, two, monkeypatch, condition, query):
    text = query.format(a=two[0], b=two[1], on=condition)
    got = Engine(spark).sql(text)
    assert "NestedLoop" not in plan_of(got) or "all_values" in plan_of(got)  # one row beside the others
    assert "Cartesian" not in plan_of(got)
    monkeypatch.setattr(bands, "counted", lambda text, *_: text)
    want = Engine(spark).sql(text)
    assert "NestedLoop" in plan_of(want) or "Cartesian" in plan_of(want)
    assert got.dtypes == want.dtypes
    assert rows(got) == rows(want)


@pytest.mark.parametrize("query", [
    "select a.k, sum(w) as n from {a} a join {b} b on b.x between a.lo and a.hi group by a.k",
    "select a.k, b.kb from {a} a join {b} b on b.x between a.lo and a.hi",
    "select a.k, b.z, count(*) as n from {a} a join {b} b on b.x between a.lo and a.hi group by a.k, b.z",
    "select a.k, count(*) as n from {a} a left join {b} b on b.x between a.lo and a.hi group by a.k",
    "select a.k, count(*) as n from {a} a join {b} b on b.x between a.lo and a.hi or b.z = 3 group by a.k",
    "select a.k, count(*) as n from {a} a join {b} b on b.x <= a.hi and b.y >= a.lo group by a.k",
    "select a.k, count(*) as n from {a} a join {b} b on b.z <= a.w and b.z >= a.lo group by a.k",
    "select a.k, count(*) as n from {a} a join {b} b on b.x <= a.hi and b.z > 2 group by a.k",
    "select a.k, count(*) as n from {a} a join {b} b on b.kb = a.k and b.x < a.hi group by a.k",
    "select a.k, count(*) as n from {a} a join {b} b on b.x < a.hi where b.z > 0 group by a.k",
    "select a.k, count(*) as n, max(max(b.x, 1)) as m from {a} a join {b} b on b.x < a.hi group by a.k",
])
def test_other_joins_stay(spark, two, monkeypatch, query):
    """They need the pairs, or aren't bands: the text is left as it was."""
    text = query.format(a=two[0], b=two[1])
    seen = []
    monkeypatch.setattr(bands, "counted", lambda text, *rest, f=bands.counted: seen.append((text, f(text, *rest))) or seen[-1][1])
    Engine(spark).sql(text)
    assert seen[0][0] == seen[0][1]


def test_the_numbers_column_hides_no_name(spark, two, monkeypatch):
    text = f"select g % 2 as matches, count(*) as n from {two[0]} a join {two[1]} b on b.x between a.lo and a.hi group by matches"
    got = rows(Engine(spark).sql(text))
    monkeypatch.setattr(bands, "counted", lambda text, *_: text)
    assert got and got == rows(Engine(spark).sql(text))


def test_range_join_makes_no_pairs(spark, data):
    plan = plan_of(catalogue.QUERIES["range_join"](spark, data))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
