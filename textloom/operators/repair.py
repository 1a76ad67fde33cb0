"""What the dialect leaves to types or to the reader, settled by the analyser's own word.

Text alone doesn't tell whether a quotient is one of integers, which column
beside an aggregate is a bare one, or whether a condition is a number. So the
query is written in the likelier form and analysed; where the analyser objects,
what it names is rewritten and the query is analysed again. Nothing is run, and
each round settles one place.
"""

from __future__ import annotations

import contextlib
import logging
import re
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from textloom.operators.sqltext import SLASH, Token, text_of, tokens

_AGGREGATES = frozenset("count sum avg total min max group_concat listagg string_agg percentile stddev_pop stddev_samp stddev var_pop var_samp variance collect_list collect_set any_value first last max_by min_by bool_or bool_and approx_count_distinct json_group_array json_group_object median mode".split())
_ROUNDS = 500


@contextlib.contextmanager
def _quiet() -> Iterator[None]:
    """Objections that are answered needn't be logged."""
    logger = logging.getLogger("SQLQueryContextLogger")
    was, logger.disabled = logger.disabled, True
    try:
        yield
    finally:
        logger.disabled = was


def analysed(spark: SparkSession, text: str, decimals: bool) -> tuple[DataFrame, str]:
    """The query's frame, and its text as it was settled. decimals: whether any may occur, so that quotients of them are looked for."""
    for _ in range(_ROUNDS):
        try:
            with _quiet():
                frame = spark.sql(text)
        except AnalysisException as e:
            new = _repaired(text, e)
            if new is None or new == text:
                raise
            text = new
            continue
        new = _decimal_quotients(frame, text) if decimals and SLASH in text else text
        if new == text:
            return frame, text
        text = new
    return spark.sql(text), text


def _repaired(text: str, e: AnalysisException) -> str | None:
    kind, given = e.getCondition() or "", e.getMessageParameters() or {}
    places = [(c.startIndex(), c.stopIndex() + 1) for c in (e.getQueryContext() or []) if c.fragment()]
    if kind == "MISSING_GROUP_BY" and places:
        return _bare_columns(text, *places[0], None)
    if kind == "MISSING_AGGREGATION":
        name = given.get("expression", "").strip('"').replace("`", "").rsplit(".", 1)[-1]
        return _bare_columns(text, 0, len(text), name)
    if kind.startswith("UNRESOLVED_COLUMN"):  # one that only ORDER BY names beside an aggregate
        return _bare_columns(text, 0, len(text), given.get("objectName", "").replace("`", "").rsplit(".", 1)[-1])
    if kind.startswith("DATATYPE_MISMATCH") and places:
        a, z = places[0]
        part = text[a:z]
        new = None
        if kind.endswith("FILTER_NOT_BOOLEAN"):
            new = _condition(part)
        elif SLASH.lower() in part.lower() and " div " in given.get("sqlExpr", ""):
            new = _real_quotient(part)
        new = new or _as_truth(part, given)
        if new is not None:
            return text[:a] + new + text[z:]
    return None


def _depths(ts: list[Token]) -> list[int]:
    """How deep each token stands in parentheses and CASE."""
    out, depth = [], 0
    for t in ts:
        if t.text == ")" or t.low == "end":
            depth -= 1
        out.append(depth)
        if t.text == "(" or t.low == "case":
            depth += 1
    return out


def _real_quotient(part: str) -> str | None:
    """The outermost quotient, which of equal ones is the last, as a real one."""
    ts = tokens(part)
    at = [i for i, d in enumerate(_depths(ts)) if not d and ts[i].low == "div" and i + 1 < len(ts) and ts[i + 1].text == "/**/"]
    if not at:
        return None
    i = at[-1]
    return text_of(ts[:i]) + "/" + text_of(ts[i + 2 :])


def _decimal_quotients(frame: DataFrame, text: str) -> str:
    """DIV takes decimals too, where the dialect has reals: such quotients, wherever the analysed plan has one, become real."""
    places = []

    def expression(x) -> None:  # noqa: ANN001
        name = x.getClass().getSimpleName()
        kids = x.children()
        if name == "IntegralDivide" and any(kids.apply(i).dataType().simpleString().startswith("decimal") for i in range(kids.size())):
            origin = x.origin()
            if origin.startIndex().isDefined():
                places.append((origin.startIndex().get(), origin.stopIndex().get() + 1))
        for i in range(kids.size()):
            expression(kids.apply(i))
        if name in ("ScalarSubquery", "Exists", "ListQuery"):
            plan(x.plan())

    def plan(p) -> None:  # noqa: ANN001
        for part, visit in ((p.expressions(), expression), (p.children(), plan)):
            for i in range(part.size()):
                visit(part.apply(i))

    plan(frame._jdf.queryExecution().analyzed())
    for a, z in sorted(set(places), reverse=True):
        if SLASH in text[a:z] and (new := _real_quotient(text[a:z])):
            return text[:a] + new + text[z:]
    return text


def _condition(select: str) -> str | None:
    """The WHERE of a select whose condition is a number: true unless that is 0."""
    ts = tokens(select)
    depths = _depths(ts)
    start = next((i for i, t in enumerate(ts) if not depths[i] and t.low in ("where", "having")), None)
    if start is None:
        return None
    end = next((i for i in range(start + 1, len(ts)) if not depths[i] and ts[i].low in ("group", "having", "window", "order", "limit", "union", "intersect", "except") or depths[i] < 0), len(ts))
    return f"{text_of(ts[: start + 1])} (({text_of(ts[start + 1 : end]).strip()}) <> 0) {text_of(ts[end:])}"


def _as_truth(part: str, given: dict[str, str]) -> str | None:
    """Numbers beside AND, OR and NOT are compared with 0; truth values inside sums and averages are counted as 0 and 1."""
    numeric = re.compile(r'"(TINYINT|SMALLINT|INT|BIGINT|DOUBLE|FLOAT)"')
    ts = tokens(part)
    depths = _depths(ts)
    for word in ("or", "and"):
        at = [i for i, t in enumerate(ts) if not depths[i] and t.low == word and not (word == "and" and any(x.low == "between" for x in ts[:i]))]
        if at:
            left, right = text_of(ts[: at[-1]]).strip(), text_of(ts[at[-1] + 1 :]).strip()
            if numeric.fullmatch(given.get("left", "")):
                left = f"(({left}) <> 0)"
            if numeric.fullmatch(given.get("right", "")):
                right = f"(({right}) <> 0)"
            return f"{left} {word} {right}"
    solid = [t for t in ts if not t.blank]
    if solid and solid[0].low == "not" and numeric.fullmatch(given.get("inputType", "")):
        return f"(({part[part.lower().index('not') + 3 :].strip()}) = 0)"
    if given.get("inputType") == '"BOOLEAN"' and len(solid) > 3 and solid[0].low in ("sum", "avg") and solid[1].text == "(":
        inner = part[part.index("(") + 1 : part.rindex(")")]
        return f"{solid[0].text}(cast(({inner}) as int))"
    return None


def _bare_columns(text: str, a: int, z: int, name: str | None) -> str | None:
    """Bare columns beside an aggregate get the value of the row that has the one MIN or MAX, or else of any row.

    name: the column that the analyser misses, in whatever select has it bare
    beside a GROUP BY; None for all of the select at a..z, which has no GROUP BY.
    """
    ts = tokens(text)
    depths = _depths(ts)
    for i in [i for i, t in enumerate(ts) if t.low == "select" and a <= t.start < z]:
        level = depths[i]
        end = next((j for j in range(i + 1, len(ts)) if depths[j] < level or (depths[j] == level and ts[j].low in ("union", "intersect"))), len(ts))
        words = [j for j in range(i + 1, end) if depths[j] == level and ts[j].kind == "word"]
        source = next((j for j in words if ts[j].low == "from"), end)
        group = next((j for j in words if ts[j].low == "group"), None)
        if (name is None) != (group is None):
            continue
        order = next((j for j in words if ts[j].low in ("having", "order") and j > source), end)
        spans = [(i + 1, source), (order, end)]
        inside, extremes = set(), []
        for lo, hi in spans:
            j = lo
            while j < hi:
                if ts[j].kind == "word" and ts[j].low in _AGGREGATES and j + 1 < hi and ts[j + 1].text == "(":
                    close = next(k for k in range(j + 2, len(ts)) if depths[k] == depths[j + 1] and ts[k].text == ")")
                    inside.update(range(j, close + 1))
                    if ts[j].low in ("min", "max") and not any(ts[k].text == "," and depths[k] == depths[j + 1] + 1 for k in range(j + 2, close)):
                        extremes.append((ts[j].low, text_of(ts[j + 2 : close]).strip()))
                    j = close
                j += 1
        one = extremes[0] if len(set(extremes)) == 1 else None
        edits = []
        for lo, hi in spans:
            j = lo
            while j < hi:
                k, path = j, []
                if j not in inside and ts[j].kind in ("word", "name"):
                    path = [ts[j].text]
                    while k + 2 < hi and ts[k + 1].text == "." and ts[k + 2].kind in ("word", "name"):
                        path.append(ts[k + 2].text)
                        k += 2
                after = next((x for x in ts[k + 1 : hi] if not x.blank), None)
                before = next((x for x in reversed(ts[lo:j]) if not x.blank), None)
                own = path[-1].strip('`"') if path else ""
                called = after is not None and after.text == "("
                if path and not called and not (before is not None and before.low in ("as", "over")) and (own.lower() == (name or own).lower()) and (name is not None or own.lower() not in _WORDS):
                    whole = text_of(ts[j : k + 1])
                    edits.append((ts[j].start, ts[k].start + len(ts[k].text), f"{one[0]}_by({whole}, {one[1]})" if one else f"any_value({whole})", whole, before, after))
                j = k + 1
        if not edits:
            continue
        for start, stop, new, whole, before, after in reversed(edits):
            plain = (before is None or before.text == "," or before.low in ("distinct", "all")) and (after is None or after.text == ",") and start < (ts[source].start if source < len(ts) else len(text))
            last = whole.rsplit(".", 1)[-1]
            text = text[:start] + new + (f" AS {last}" if plain else "") + text[stop:]
        return text
    return None


#: Words in a select list that aren't columns.
_WORDS = frozenset("and or not is null true false like ilike rlike in between case when then else end as asc desc nulls first last distinct all div interval from by order having cast collate utf8_lcase bigint int integer double string over partition rows range current row unbounded preceding following filter where escape exists".split())
