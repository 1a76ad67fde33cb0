"""Counts over a band join, from the order of the values instead of from the pairs.

`from a join b on b.x between a.lo and a.hi`, where all else names columns of
one table only and what is aggregated counts pairs (or doesn't mind copies),
needs no pair: a row's matches are the values up to its upper bound less those
below its lower one. Spark has only nested loops for such a join, so rows times
rows are compared; here each table is sorted. The join becomes a view of the
table that is kept, with each row's number of matches, and count(*) sums that.

The values are cut into stretches at quantiles, which one small job finds when
the query is planned; they settle who counts what and not what is counted.
Whatever isn't plainly of this form is left as it stands.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.sqltext import Token, tokens

#: Stretches of values, each counted by one task; and the quantiles' accuracy.
STRETCHES, ACCURACY = 128, 10_000

_CLAUSES = ("where", "group", "having", "order", "limit", "offset")
_FORBIDDEN = frozenset("with union intersect except over window lateral pivot unpivot filter exists using left right full outer cross natural semi anti tablesample qualify any some cube rollup grouping sets".split())
_KEYWORDS = frozenset("select all distinct from where group by having order limit offset as and or not in is null true false between like ilike rlike case when then else end asc desc nulls first last div cast bigint int integer double string interval escape".split())
_BEFORE_PARENTHESIS = frozenset("select where having by and or not in between when then else case like ilike rlike div on distinct".split())
#: Functions of single values; anything else that is called, but for count, min and max, leaves the query as it is.
_OF_VALUES = frozenset("abs cast ceil coalesce concat floor length lower nullif round substr trim upper".split())
#: Stands for a row's number of matches until the column's name is known.
_NUMBER = "\0"
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass
class Table:
    view: str
    alias: str
    frame: DataFrame

    @property
    def columns(self) -> set[str]:
        return {c.lower() for c in self.frame.columns}

    @property
    def source(self) -> str:
        return f"{_named(self.view)} AS {_named(self.alias)}"


@dataclass
class Step:
    """So many values of the other table lie below (or up to) one of the kept table: added, taken away, or taken from all there are."""

    kept: str
    other: str
    inclusive: bool
    sign: int = 1


def counted(text: str, frames: dict[str, DataFrame], analysed: Callable[[str], DataFrame]) -> str:
    """The query over a view of counts if it is one that only counts a band join's pairs, else the text itself. analysed: the frame of a text."""
    found = _parsed(text, {k.lower(): v for k, v in frames.items()})
    if found is None:
        return text
    kept, other, terms, edits, (a, z) = found
    made = _matches(kept, other, terms, analysed, text.lower())
    if made is None:
        return text
    frame, column = made
    view = f"band_{uuid.uuid4().hex}"
    frame.createOrReplaceTempView(view)
    for start, end, new in sorted([*edits, (a, z, f"{_named(view)} AS {_named(kept.alias)} ")], reverse=True):
        text = text[:start] + new.replace(_NUMBER, f"{_named(kept.alias)}.{_named(column)}") + text[end:]
    return text


def _named(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _plain(t: Token) -> str:
    return t.text[1:-1].replace("``", "`") if t.kind == "name" else t.text


def _paths(ts: list[Token]) -> list[list[str]]:
    """The names in a text, each with its qualifiers; suffixes of numbers (5D) and what AS gives aren't any."""
    out, i = [], 0
    while i < len(ts):
        t = ts[i]
        suffix = i > 0 and ts[i - 1].kind == "number" and ts[i - 1].start + len(ts[i - 1].text) == t.start
        if t.kind == "name" or (t.kind == "word" and not suffix and (t.low not in _KEYWORDS or (i > 0 and ts[i - 1].text == "."))):
            path, first = [_plain(t)], i
            while i + 2 < len(ts) and ts[i + 1].text == "." and ts[i + 2].kind in ("word", "name"):
                path.append(_plain(ts[i + 2]))
                i += 2
            if not (t.kind == "word" and len(path) == 1 and i + 1 < len(ts) and ts[i + 1].text == "("):
                if not (len(path) == 1 and first and ts[first - 1].low == "as"):
                    out.append(path)
        i += 1
    return out


def _owner(path: list[str], both: tuple[Table, Table]) -> int | None:
    """Which table a name is of: 0, 1, 2 where it is of neither (perhaps a name of the select's own), None if that is unclear."""
    if len(path) == 2:
        hits = [i for i, t in enumerate(both) if t.alias.lower() == path[0].lower()]
        return hits[0] if len(hits) == 1 and path[1].lower() in both[hits[0]].columns else None
    hits = [i for i, t in enumerate(both) if path[0].lower() in t.columns]
    return None if len(path) > 2 or len(hits) > 1 else hits[0] if hits else 2


def _flat(ts: list[Token], at: Callable[[Token], bool]) -> list[int]:
    """Places outside of parentheses and CASE of tokens."""
    out, depth = [], 0
    for i, t in enumerate(ts):
        depth -= t.text == ")" or t.low == "end"
        if not depth and at(t):
            out.append(i)
        depth += t.text == "(" or t.low == "case"
    return out


def _terms(ts: list[Token]) -> list[tuple[list[Token], str, list[Token]]] | None:
    """The comparisons of a condition, which are all joined by AND; None if it is anything else."""
    if any(t.kind == "string" or t.low in (_KEYWORDS - {"between", "and", "div"}) or (t.kind in ("word", "name") and t.low not in ("between", "and", "div") and n.text == "(") for t, n in zip(ts, [*ts[1:], Token("op", "", 0)], strict=True)):
        return None
    parts, start, between = [], 0, False
    for i in _flat(ts, lambda t: t.low in ("between", "and")):
        if ts[i].low == "between":
            if between:
                return None
            between = True
        elif between:
            between = False
        else:
            parts.append(ts[start:i])
            start = i + 1
    out = []
    for part in [*parts, ts[start:]]:
        signs = _flat(part, lambda t: t.low in ("between", "and") or (t.kind == "op" and t.text in ("<", "<=", ">", ">=", "=", "==", "<>", "!=", "<=>")))
        if [part[i].low for i in signs] == ["between", "and"]:
            a, z = signs
            out += [(part[:a], ">=", part[a + 1 : z]), (part[:a], "<=", part[z + 1 :])]
        elif len(signs) == 1 and part[signs[0]].text in _TURNED:
            out.append((part[: signs[0]], part[signs[0]].text, part[signs[0] + 1 :]))
        else:
            return None
    return out


def _parsed(text: str, frames: dict[str, DataFrame]):  # noqa: ANN202
    """The table that is kept, the other one, the comparisons with the other's side first, what to replace, and where the join stands."""
    ts = [t for t in tokens(text) if not t.blank]
    lows = [t.low for t in ts]
    if lows.count("select") != 1 or lows.count("join") != 1 or lows.count("from") != 1 or lows[0] != "select" or _FORBIDDEN & {t.low for t in ts if t.kind == "word"}:
        return None
    start = lows.index("from")
    i, both = start + 1, []
    for ends in (("inner", "join"), ("on",)):
        if i >= len(ts) or ts[i].kind != "name" or (view := _plain(ts[i])).lower() not in frames:
            return None
        i += 1
        i += i < len(ts) and lows[i] == "as"
        alias = view
        if i < len(ts) and ts[i].kind in ("word", "name") and lows[i] not in ends:
            alias = _plain(ts[i])
            i += 1
        if "inner" in ends:
            i += i < len(ts) and lows[i] == "inner"
        if i >= len(ts) or lows[i] != ends[-1]:
            return None
        i += 1
        both.append(Table(view, alias, frames[view.lower()]))
    if both[0].alias.lower() == both[1].alias.lower() or any(len(t.columns) < len(t.frame.columns) for t in both):
        return None
    end = next((i + j for j in _flat(ts[i:], lambda t: t.low in _CLAUSES)), len(ts))
    condition, rest = ts[i:end], [ts[:start], ts[end:]]
    if ";" in lows or (terms := _terms(condition)) is None:
        return None
    owners = {_owner(p, both) for part in rest for p in _paths(part)} - {2}
    if None in owners or len(owners) > 1:
        return None
    k = owners.pop() if owners else 0
    turned = []
    for left, op, right in terms:
        of = [{_owner(p, both) for p in _paths(side)} for side in (left, right)]
        if of == [{1 - k}, {k}]:
            turned.append((_spaced(left), op, _spaced(right)))
        elif of == [{k}, {1 - k}]:
            turned.append((_spaced(right), _TURNED[op], _spaced(left)))
        else:
            return None
    edits = []
    for part in rest:
        for j, t in enumerate(part):
            if t.text == "*" and (not j or part[j - 1].low in ("select", "all", "distinct", ",", ".")):
                return None
            if t.text != "(" or not j or part[j - 1].kind not in ("word", "name") or part[j - 1].low in _BEFORE_PARENTHESIS:
                continue
            name = part[j - 1].low if part[j - 1].kind == "word" else ""
            close = _closing(part, j)
            inside = part[j + 1 : close]
            if name in ("count", "min", "max"):
                if close >= len(part) or not inside or _flat(inside, lambda x: x.text == ",") or any(x.text == "(" and inside[y - 1].low in ("count", "min", "max") for y, x in enumerate(inside) if y):
                    return None
                if name == "count" and inside[0].low != "distinct":
                    known = [x.text for x in inside] == ["*"] or (len(inside) == 1 and inside[0].kind == "number")
                    what = _NUMBER if known else f"if(({_spaced(inside)}) IS NOT NULL, {_NUMBER}, 0L)"
                    edits.append((part[j - 1].start, part[close].start + 1, f"coalesce(sum({what}), 0L)"))
            elif name not in _OF_VALUES:
                return None
    aggregates = any(t.low in ("count", "min", "max") and n.text == "(" for part in rest for t, n in zip(part, part[1:], strict=False))
    if not aggregates and "group" not in lows:
        return None
    span = (ts[start + 1].start, ts[end].start if end < len(ts) else len(text))
    return both[k], both[1 - k], turned, edits, span


def _closing(ts: list[Token], i: int) -> int:
    depth = 0
    for j in range(i, len(ts)):
        depth += (ts[j].text == "(") - (ts[j].text == ")")
        if not depth:
            return j
    return len(ts)


def _spaced(ts: list[Token]) -> str:
    """Tokens with a blank wherever there was one, so that equal expressions have equal texts, and DIV its mark."""
    out = ""
    for i, t in enumerate(ts):
        gap = i and ts[i - 1].start + len(ts[i - 1].text) < t.start
        out += ("/**/ " if i and ts[i - 1].low == "div" else " " if gap else "") + t.text
    return out


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _common(a: str, b: str) -> str | None:
    """The type in which Spark compares values of these types; None if it isn't one of those that are counted here."""
    if a in _NUMBERS and b in _NUMBERS:
        return max(a, b, key=_NUMBERS.index)
    return a if a == b and (a in ("date", "timestamp", "timestamp_ntz") or a.startswith("decimal")) else None


def _matches(kept: Table, other: Table, terms: list[tuple[str, str, str]], analysed: Callable[[str], DataFrame], text: str) -> tuple[DataFrame, str] | None:
    """The kept table's rows that have matches, with their number in a column whose name the query's text doesn't have."""
    lower = [t for t in terms if t[1] in (">", ">=")]
    upper = [t for t in terms if t[1] in ("<", "<=")]
    if len(lower) > 1 or len(upper) > 1:
        return None
    # the other side's value is at least (lower) or at most (upper) the kept side's
    steps = [Step(k, o, op == "<=") for o, op, k in upper] + [Step(k, o, op == ">", -1) for o, op, k in lower]
    closed = None
    if len(steps) == 2 and steps[0].other != steps[1].other:
        if steps[0].kept != steps[1].kept:
            return None
        # the other table's rows are intervals, from what is at most the kept value to what is at least it; those that are empty match nothing
        closed = steps[0].inclusive and not steps[1].inclusive
    taken = kept.columns
    free = lambda name: name if name not in taken and name not in text else free(f"_{name}")
    ours = list(dict.fromkeys(s.kept for s in steps))
    theirs = list(dict.fromkeys(s.other for s in steps))
    own = {x: free(f"bound{i}") for i, x in enumerate(ours)}
    rows = analysed(f"SELECT {_named(kept.alias)}.*, {', '.join(f'({x}) AS {c}' for x, c in own.items())} FROM {kept.source}")
    values = analysed(f"SELECT {', '.join(f'({x}) AS value{i}' for i, x in enumerate(theirs))} FROM {other.source}")
    kinds, there = dict(rows.dtypes), [k for _, k in values.dtypes]
    compared = {_common(kinds[own[s.kept]], there[theirs.index(s.other)]) for s in steps}
    if None in compared or len(compared) > 1:
        return None
    (to,) = compared
    rows = rows.withColumns({c: F.col(c).cast(to) for c in own.values()}).where(" AND ".join(f"{c} IS NOT NULL" for c in own.values()))
    values = values.select(*[F.col(c).cast(to).alias(c) for c in values.columns])
    if closed is not None:
        values = values.where("value0 <= value1" if closed else "value0 < value1")
    stretch = _stretches([rows.select(F.col(c).alias("v")) for c in own.values()] + [values.select(F.col(c).alias("v")) for c in values.columns], to)
    number, total = free("matches"), F.lit(0)
    out = rows
    for i, s in enumerate(steps):
        at, c = free(f"at{i}"), free(f"upto{i}")
        points = values.select(F.col(f"value{theirs.index(s.other)}").alias("v")).where("v is not null")
        out = out.join(_below(points, rows.select(F.col(own[s.kept]).alias("v")), s.inclusive, stretch).toDF(at, c), F.col(own[s.kept]) == F.col(at))
        total = total + s.sign * F.col(c)
    if len(steps) == 1 and lower:
        all_there = free("all_values")
        out = out.crossJoin(F.broadcast(points.agg(F.count("*").alias(all_there))))
        total = total + F.col(all_there)
    out = out.withColumn(number, total).where(F.col(number) > 0)
    return out.select(*[_named(c) for c in kept.frame.columns], number), number


def _stretches(columns: list[DataFrame], kind: str) -> Callable[[Column], Column]:
    """Which stretch a value is in: so many of the bounds lie below it."""
    everything = functools.reduce(DataFrame.unionAll, columns)
    if kind in ("float", "double"):
        everything = everything.where(~F.isnan("v"))
    shares = [i / STRETCHES for i in range(1, STRETCHES)]
    bounds = sorted(set(everything.agg(F.percentile_approx("v", shares, ACCURACY)).first()[0] or []))

    def tree(v: Column, lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v <= F.lit(bounds[mid]).cast(kind), tree(v, lo, mid)).otherwise(tree(v, mid + 1, hi))

    return lambda v: tree(v, 0, len(bounds))


def _below(points: DataFrame, wanted: DataFrame, inclusive: bool, stretch: Callable[[Column], Column]) -> DataFrame:
    """For each value that is wanted, how many points lie below it, or up to it.

    A point counts within its stretch by a running sum over unlike values, and
    for all later stretches by the sum of its own.
    """
    within = points.withColumn("n", F.lit(1)).unionAll(wanted.withColumn("n", F.lit(0))).groupBy("v").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("stretch").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    within = within.withColumn("stretch", stretch(F.col("v"))).select("v", "stretch", (upto if inclusive else upto - F.col("n")).alias("here"))
    each = points.groupBy(stretch(F.col("v")).alias("s")).agg(F.count("*").alias("n"))
    later = each.where(F.col("s") < STRETCHES - 1).select(F.explode(F.sequence(F.col("s") + 1, F.lit(STRETCHES - 1))).alias("s"), "n").groupBy("s").agg(F.sum("n").alias("before"))
    return within.join(F.broadcast(later), F.col("stretch") == F.col("s"), "left").select("v", (F.col("here") + F.coalesce("before", F.lit(0))).alias("n"))
