"""SQL text: tokens, table references that are file names, and the dialect's functions.

The text is cut into tokens that keep strings, quoted names and comments
whole, so only real references after FROM or JOIN are taken for tables: not
what stands in a literal, in EXTRACT(.. FROM ..), in IS DISTINCT FROM, a
sub-query, a table function or the name of a common table expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from textloom import errors
from textloom.errors import EngineError

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<name>`(?:[^`]|``)*`|"(?:[^"]|"")*")|(?P<number>(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|(?P<word>[^\W\d]\w*)|(?P<op>\|\||<=>|<>|!=|==|>=|<=|<<|>>|->>|->|.)""",
    re.S | re.X,
)
#: How a slash is written until its operands turn out not to be integers.
SLASH = "DIV/**/"
_ENDS = {"where", "group", "order", "having", "limit", "union", "intersect", "except", "window", "on", "using", "offset", "select"}
_FUNCTIONS_WITH_FROM = {"extract", "trim", "substring", "substr", "overlay", "position"}


@dataclass
class Token:
    kind: str
    text: str
    start: int

    @property
    def low(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text

    @property
    def blank(self) -> bool:
        return self.kind in ("space", "comment")


def tokens(sql: str) -> list[Token]:
    out = []
    for m in _TOKEN.finditer(sql):
        out.append(Token(m.lastgroup or "op", m.group(), m.start()))
    return out


def text_of(ts: list[Token]) -> str:
    return "".join(t.text for t in ts)


def cte_names(ts: list[Token]) -> set[str]:
    """Names that WITH gives: a name, perhaps columns, AS, an opening parenthesis."""
    solid = [t for t in ts if not t.blank]
    found = set()
    if not any(t.low == "with" for t in solid):
        return found
    for i, t in enumerate(solid):
        if t.kind not in ("word", "name") or i == 0:
            continue
        before = solid[i - 1].low
        if before not in ("with", "recursive", ","):
            continue
        j = i + 1
        if j < len(solid) and solid[j].text == "(":
            depth = 0
            while j < len(solid):
                depth += (solid[j].text == "(") - (solid[j].text == ")")
                j += 1
                if not depth:
                    break
        if j + 1 < len(solid) and solid[j].low == "as" and solid[j + 1].text == "(":
            found.add(t.text.strip('`"').lower())
    return found


@dataclass
class Reference:
    name: str
    start: int
    end: int


def references(sql: str) -> list[Reference]:
    """Table references after FROM, JOIN and commas of a FROM list, with their places in the text."""
    ts = tokens(sql)
    ctes = cte_names(ts)
    found: list[Reference] = []
    stack: list[dict] = [{"from": False, "function": False}]
    expect, skip_to, previous = False, -1, []
    for i, t in enumerate(ts):
        if t.start < skip_to or t.blank:
            continue
        if expect:
            if t.text == "(":
                nxt = next((x for x in ts[i + 1 :] if not x.blank), None)
                inner = bool(nxt) and nxt.low not in ("select", "with", "values")
                stack.append({"from": inner, "function": False})
                expect = inner
                previous.append(t)
                continue
            expect = False
            if t.low == "lateral":
                expect = True
                continue
            if t.kind == "name":
                name, end = t.text[1:-1].replace(t.text[0] * 2, t.text[0]), t.start + len(t.text)
                rest = re.compile(r"[^\s,();]*").match(sql, end)
                if t.text[0] == '"' or t.text[0] == "`":
                    if rest and rest.group().startswith(":::"):
                        name, end = name + rest.group(), rest.end()
            else:
                m = re.compile(r"[^\s,();]+").match(sql, t.start)
                if not m:
                    raise EngineError(errors.NO_TABLE, "FROM or JOIN without a table name")
                name, end = m.group(), m.end()
                if end < len(sql) and sql[end] == "(":  # a table function
                    skip_to = end
                    previous.append(t)
                    continue
            if t.low in _ENDS:
                raise EngineError(errors.NO_TABLE, f"FROM or JOIN is followed by '{t.text}' and not by a table name")
            if name.lower() not in ctes and t.low not in ("values", "unnest"):
                found.append(Reference(name, t.start, end))
            skip_to = end
            previous.append(t)
            continue
        top = stack[-1]
        if t.text == "(":
            last = previous[-1].low if previous else ""
            stack.append({"from": False, "function": last in _FUNCTIONS_WITH_FROM})
        elif t.text == ")":
            if len(stack) > 1:
                stack.pop()
        elif t.low == "from":
            distinct = len(previous) > 1 and previous[-1].low == "distinct" and previous[-2].low in ("is", "not")
            if not top["function"] and not distinct:
                top["from"] = expect = True
        elif t.low == "join":
            top["from"] = expect = True
        elif t.text == "," and top["from"]:
            expect = True
        elif t.low in _ENDS - {"on", "using"}:
            top["from"] = False
        previous.append(t)
    if expect:
        raise EngineError(errors.NO_TABLE, "FROM or JOIN without a table name")
    return found


def with_tables(sql: str, resolve: Callable[[str], str]) -> tuple[str, dict[str, str]]:
    """The text with each reference replaced by what `resolve` gives for it, and those by name."""
    got: dict[str, str] = {}
    out, at = [], 0
    for ref in references(sql):
        if ref.name not in got:
            got[ref.name] = resolve(ref.name)
        out += [sql[at : ref.start], got[ref.name]]
        at = ref.end
    return "".join(out) + sql[at:], got


def is_select(sql: str) -> bool:
    first = next((t.low for t in tokens(sql) if not t.blank and t.text != "("), "")
    return first in ("select", "with", "values", "from", "table")


# --- functions


def _call(ts: list[Token], i: int) -> tuple[list[list[Token]], int] | None:
    """The arguments of a call whose name is token i, and the token after its parenthesis."""
    j = i + 1
    if j >= len(ts) or ts[j].text != "(":
        return None
    depth, args, current = 0, [], []
    while j < len(ts):
        x = ts[j].text if ts[j].kind == "op" else ""
        if x == "(":
            depth += 1
            if depth == 1:
                j += 1
                continue
        elif x == ")":
            depth -= 1
            if not depth:
                if args or text_of(current).strip():
                    args.append(current)
                return args, j + 1
        if x == "," and depth == 1:
            args.append(current)
            current = []
        else:
            current.append(ts[j])
        j += 1
    return None


#: Aggregates that take more than a new name when they stand over a window.
OVER: dict[str, Callable[[str, str], str]] = {
    "total": lambda x, over: f"coalesce(cast(sum({x}) {over} as double), 0d)",
    "stddev_pop": lambda x, over: f"(case when count({x}) {over} > 1 then stddev_pop({x}) {over} end)",
    "stddev_sample": lambda x, over: f"stddev_samp({x}) {over}",
}


def rewrite_calls(sql: str, table: dict[str, Callable[[list[str]], str | None]]) -> str:
    """Calls of the table's names become what its entries make of their arguments (None: as they stand), inside out."""
    ts = tokens(sql)
    out, i = [], 0
    while i < len(ts):
        t = ts[i]
        got = _call(ts, i) if t.kind == "word" and t.low in table and not (i and ts[i - 1].text == ".") else None
        if got:
            args, after = got
            parts = [rewrite_calls(text_of(a), table).strip() for a in args]
            tail = next((x.low for x in ts[after:] if not x.blank), "")
            if tail == "over" and t.low in OVER and len(parts) == 1:
                # the whole window goes beside each aggregate that stands for the call
                over = next(j for j in range(after, len(ts)) if ts[j].low == "over")
                spec = next(j for j in range(over + 1, len(ts)) if not ts[j].blank)
                after = (_close(ts, spec) if ts[spec].text == "(" else spec) + 1
                out.append(OVER[t.low](parts[0], rewrite_calls(text_of(ts[over:after]), table)))
                i = after
                continue
            new = table[t.low](parts) if tail not in ("over", "within") or t.low == "group_concat" else None
            out.append(new if new is not None else f"{t.text}({', '.join(parts)})")
            i = after
        else:
            out.append(t.text)
            i += 1
    return "".join(out)


_BINARY = ("||", "+", "-", "*", "/", "%")
_INTEGERS = ("int", "integer", "bigint", "smallint", "tinyint")
_REALS = ("real", "double", "float", "numeric")


def _close(ts: list[Token], i: int) -> int:
    """The parenthesis that closes the one at i, or the last token."""
    depth = 0
    for j in range(i, len(ts)):
        depth += (ts[j].text == "(") - (ts[j].text == ")")
        if not depth:
            return j
    return len(ts) - 1


def _operand_before(ts: list[Token], i: int) -> int:
    """Where the operand that ends before token i starts: primaries joined by operators that bind more tightly."""
    j = i
    while True:
        j -= 1
        while j > 0 and ts[j].blank:
            j -= 1
        if ts[j].text == ")":
            depth = 0
            while j >= 0:
                depth += (ts[j].text == ")") - (ts[j].text == "(")
                if not depth:
                    break
                j -= 1
            if j and ts[j - 1].kind == "word" and ts[j - 1].low not in ("and", "or", "not", "where", "when", "then", "else", "on", "select", "having", "by", "in"):
                j -= 1
        elif ts[j].low == "end":
            depth = 0
            while j >= 0:
                depth += (ts[j].low == "end") - (ts[j].low == "case")
                if not depth:
                    break
                j -= 1
        while j > 1 and ts[j - 1].text == ".":
            j -= 2
        k = j - 1
        while k >= 0 and ts[k].blank:
            k -= 1
        if k < 0 or ts[k].text not in _BINARY:
            return max(j, 0)
        j = k


def _operand_after(ts: list[Token], i: int) -> int:
    """The token after the operand that starts after token i."""
    j = i + 1
    while True:
        while j < len(ts) and (ts[j].blank or ts[j].text in ("-", "+", "~")):
            j += 1
        if j < len(ts) and ts[j].low == "case":
            depth = 0
            while j < len(ts):
                depth += (ts[j].low == "case") - (ts[j].low == "end")
                if not depth:
                    break
                j += 1
        else:
            while j + 2 < len(ts) and ts[j + 1].text == ".":
                j += 2
            if j + 1 < len(ts) and ts[j].kind in ("word", "name") and ts[j + 1].text == "(":
                j += 1
            if j < len(ts) and ts[j].text == "(":
                j = _close(ts, j)
        j += 1
        k = j
        while k < len(ts) and ts[k].blank:
            k += 1
        if k >= len(ts) or ts[k].text not in _BINARY:
            return j
        j = k + 1


_ODD_IN_GLOB = r"'([.+^$|(){}\\\\])'"


def glob_match(pattern: str, value: str) -> str:
    """GLOB as an expression; a pattern that isn't a literal is translated row by row."""
    text = pattern.strip()
    if re.fullmatch(r"'(?:[^']|'')*'", text, re.S):
        return f"(({value}) RLIKE {glob_pattern(text[1:-1].replace(chr(39) * 2, chr(39)))})"
    made = f"regexp_replace({text}, {_ODD_IN_GLOB}, '{chr(92) * 4}$1')"
    return f"(({value}) RLIKE concat('(?s)^', replace(replace({made}, '*', '.*'), '?', '.'), '$'))"


def _infix(sql: str) -> str:
    """x REGEXP p and x GLOB p, also with NOT, as the expressions they stand for. A null is no match for REGEXP, and null for GLOB."""
    while True:
        ts = tokens(sql)
        for i, t in enumerate(ts):
            if t.low not in ("regexp", "glob") or i + 1 >= len(ts) or ts[i + 1].text == "(" or not i or ts[i - 1].text == ".":
                continue
            before = i
            while before and ts[before - 1].blank:
                before -= 1
            negated = before > 0 and ts[before - 1].low == "not"
            if negated:
                before -= 1
            start, end = _operand_before(ts, before), _operand_after(ts, i)
            left, right = text_of(ts[start:before]).strip(), text_of(ts[i + 1 : end]).strip()
            if not left or not right:
                continue
            found = f"(regexp({right}, {left}) = 1)" if t.low == "regexp" else glob_match(right, left)
            sql = text_of(ts[:start]) + (f"(NOT {found})" if negated else found) + text_of(ts[end:])
            break
        else:
            return sql


def _cast(ts: list[Token], i: int) -> tuple[str, int] | None:
    """CAST at token i: the number that a text begins with, or 0; other values are cast as they are."""
    if i + 1 >= len(ts) or ts[i + 1].text != "(":
        return None
    end, depth, at = _close(ts, i + 1), 0, None
    for j in range(i + 2, end):
        depth += (ts[j].text == "(") - (ts[j].text == ")")
        if not depth and ts[j].low == "as":
            at = j
    if at is None:
        return None
    kind, x = text_of(ts[at + 1 : end]).strip().lower(), rewrite_operators(text_of(ts[i + 2 : at]).strip())
    if kind in _INTEGERS:
        to, first, zero = "bigint", r"^\\s*[+-]?[0-9]+", "0L"
    elif kind in _REALS:
        to, first, zero = "double", r"^\\s*[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?", "0D"
    elif kind in ("text", "clob") or re.fullmatch(r"(var)?char(\s*\(\s*\d+\s*\))?", kind):
        return f"CAST({x} AS STRING)", end + 1
    elif kind == "blob":
        return f"CAST({x} AS BINARY)", end + 1
    else:
        return f"{ts[i].text}({x} AS {text_of(ts[at + 1 : end]).strip()})", end + 1
    # typeof is settled before the query runs, so only the branch of the column's type is left
    prefix = f"coalesce(try_cast(regexp_substr(CAST({x} AS STRING), '{first}') AS {to}), {zero})"
    return f"(CASE WHEN textloom_typeof({x}) <> 'string' THEN CAST({x} AS {to}) WHEN ({x}) IS NOT NULL THEN {prefix} END)", end + 1


def rewrite_operators(sql: str) -> str:
    """Literals with a point are reals, a slash divides integers as integers (see `repair`), LIKE without regard to case, GLOB and REGEXP, IS with a value, CAST by prefixes, COLLATE NOCASE, hex literals, LIMIT m, n."""
    ts = tokens(_infix(sql))
    out: list[str] = []
    i = 0
    while i < len(ts):
        t = ts[i]
        solid = [x for x in ts[i + 1 : i + 8] if not x.blank]
        if t.low == "like" and not (solid and solid[0].text == "("):
            out.append("ILIKE")
        elif t.low == "cast" and (made := _cast(ts, i)):
            out.append(made[0])
            i = made[1]
            continue
        elif t.text == "/" and t.kind == "op":
            out.append(f" {SLASH} ")
        elif t.low == "is" and solid and (solid[0].kind in ("number", "string") or (solid[0].low == "not" and len(solid) > 1 and solid[1].kind in ("number", "string"))):
            negated = solid[0].low == "not"
            out.append("IS NOT DISTINCT FROM" if not negated else "IS DISTINCT FROM")
            if negated:
                i = ts.index(solid[0], i)
        elif t.low == "collate" and solid and solid[0].low == "nocase":
            out.append("COLLATE UTF8_LCASE")
            i = ts.index(solid[0], i)
        elif t.low == "x" and i + 1 < len(ts) and ts[i + 1].kind == "string" and re.fullmatch(r"'(?:[0-9a-fA-F]{2})*'", ts[i + 1].text):
            out.append(f"CAST(X{ts[i + 1].text} AS STRING)")
            i += 1
        elif t.low == "limit" and len(solid) > 2 and solid[0].kind == "number" and solid[1].text == "," and solid[2].kind == "number":
            out.append(f"LIMIT {solid[2].text} OFFSET {solid[0].text}")
            i = ts.index(solid[2], i)
        elif t.kind == "number" and not t.text.isdigit():
            out.append(t.text + "D")  # a real, not a decimal
        elif t.kind == "name" and t.text[0] == '"':
            out.append("`" + t.text[1:-1].replace('""', '"').replace("`", "``") + "`")
        else:
            out.append(t.text)
        i += 1
    return "".join(out)


def glob_pattern(glob: str) -> str:
    """GLOB's pattern as a whole-string regular expression, quoted for SQL."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out += "[" + body.replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return "'" + ("(?s)^" + out + "$").replace("\\", "\\\\").replace("'", "\\'") + "'"


def name_columns(sql: str) -> str:
    """Expressions of the outermost select list that have no name get their own text as one."""
    ts = tokens(sql)
    start = next((i for i, t in enumerate(ts) if not t.blank), None)
    if start is None or ts[start].low != "select":
        return sql
    depth, items, current, end = 0, [], [], len(ts)
    i = start + 1
    while i < len(ts) and (ts[i].blank or ts[i].low in ("distinct", "all")):
        i += 1
    head = text_of(ts[:i])
    while i < len(ts):
        t = ts[i]
        depth += (t.text == "(") - (t.text == ")")
        if not depth and t.low in ("from", "union", "intersect", "except", "where", "group", "order", "limit", "having", ";") and not (t.low == "from" and len(current) > 2 and [x.low for x in current if not x.blank][-1:] == ["distinct"]):
            end = i
            break
        if not depth and t.text == ",":
            items.append(current)
            current = []
        else:
            current.append(t)
        i += 1
    items.append(current)
    named = []
    for item in items:
        solid = [t for t in item if not t.blank]
        text = text_of(item).strip()
        plain = not solid or solid[-1].text == "*" and len(solid) in (1, 3) or all(t.kind in ("word", "name") or t.text == "." for t in solid) and len(solid) in (1, 3)
        level, has_as = 0, False
        for t in solid:
            level += (t.text == "(") - (t.text == ")")
            has_as |= not level and t.low == "as"
        implied = len(solid) > 1 and solid[-1].kind in ("word", "name") and solid[-1].low not in ("end", "null", "true", "false", "nocase") and (solid[-2].kind in ("word", "name", "number", "string") and solid[-2].low not in ("not", "and", "or", "in", "is", "like", "between", "div", "then", "else", "when", "case", "rlike", "ilike", "regexp", "glob", "collate", "from") or solid[-2].text == ")")
        lead = text_of(item)[: len(text_of(item)) - len(text_of(item).lstrip())]
        named.append(text_of(item) if plain or has_as or implied else f"{lead}{text} AS `{text.replace('`', '``')}` ")
    return head + ",".join(named) + text_of(ts[end:])
