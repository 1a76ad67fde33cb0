"""GROUPS frames and EXCLUDE, which Spark's windows lack, from frames that it has.

A select with such a frame becomes a pipe: its source is extended by the dense
rank of each window's order, and the frame is written as a RANGE over that
rank. A frame that excludes something is put together from the pieces that are
left, each a window of its own, by what the aggregate adds up to: counts and
sums are added (or taken away, where what is excluded is a frame itself),
least and greatest values compared. All of them share the window's sort.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from textloom import errors
from textloom.errors import EngineError
from textloom.operators.sqltext import Token, text_of, tokens

_CLAUSES = ("from", "where", "group", "having", "window", "order", "limit", "offset")
_SET = ("union", "intersect", "except")


@dataclass
class Spec:
    """A window: what it is partitioned and ordered by, its frame, and what that excludes."""

    partition: str
    order: str
    unit: str
    start: str
    end: str
    exclude: str


def _unsupported(what: str) -> EngineError:
    return EngineError(errors.SQL, f"{what} is not supported; write it as a sub-query")


def _closing(ts: list[Token], i: int) -> int:
    """The parenthesis that closes the one at i."""
    depth = 0
    for j in range(i, len(ts)):
        depth += (ts[j].text == "(") - (ts[j].text == ")")
        if not depth:
            return j
    raise EngineError(errors.SQL, "A parenthesis is not closed")


def _odd(ts: list[Token]) -> bool:
    """Whether a window's tokens have a GROUPS frame or EXCLUDE."""
    depth = 0
    for i, t in enumerate(ts):
        depth += (t.text == "(") - (t.text == ")")
        if not depth and (t.low == "exclude" or (t.low == "groups" and any(x.low in ("between", "unbounded", "current", "preceding", "following") for x in ts[i + 1 :]))):
            return True
    return False


def parsed(text: str) -> Spec:
    flat = " ".join(text.split())
    m = re.fullmatch(r"(?is)(?:partition by (?P<p>.*?))??\s*(?:order by (?P<o>.*?))??\s*(?:\b(?P<u>rows|range|groups) (?P<f>.*?))??\s*(?:\bexclude (?P<x>no others|current row|group|ties))?", flat)
    if not m:
        raise _unsupported(f"The window ({flat})")
    unit, frame = (m["u"] or "range").lower(), (m["f"] or "").lower()
    between = re.fullmatch(r"between (.*) and (.*)", frame)
    start, end = between.groups() if between else (frame or "unbounded preceding", "current row")
    if not m["o"] and not frame:
        end = "unbounded following"
    return Spec((m["p"] or "").strip(), (m["o"] or "").strip(), unit, start, end, (m["x"] or "no others").lower())


def _bound(text: str) -> float | None:
    """A frame's bound as a distance, negative before the row; None if it isn't a plain number."""
    if text == "current row":
        return 0
    m = re.fullmatch(r"(unbounded|\d+) (preceding|following)", text)
    return (float("inf") if m[1] == "unbounded" else int(m[1])) * (-1 if m[2] == "preceding" else 1) if m else None


class Block:
    """One select: the ranks that its windows need, and its expressions with frames that Spark has."""

    def __init__(self, number: int) -> None:
        self.prefix, self.extra = f"__frame{number}_", {}

    def column(self, expression: str) -> str:
        return self.extra.setdefault(expression, f"{self.prefix}{len(self.extra)}")

    def over(self, partition: str, order: str, frame: str) -> str:
        return " over (" + " ".join(x for x in (f"partition by {partition}" if partition else "", f"order by {order}" if order else "", frame) if x) + ")"

    def rank(self, spec: Spec, kind: str = "dense_rank") -> str:
        if not spec.order:
            return self.column("1")
        return self.column(f"{kind}()" + self.over(spec.partition, spec.order, ""))

    def call(self, name: str, args: str, spec: Spec) -> str:
        if spec.exclude == "no others":
            if spec.unit != "groups":
                return f"{name}({args})" + self.over(spec.partition, spec.order, f"{spec.unit} between {spec.start} and {spec.end}")
            return f"{name}({args})" + self.over(spec.partition, self.rank(spec), f"range between {spec.start} and {spec.end}")
        return self.put_together(name.lower(), args, spec)

    def pieces(self, spec: Spec) -> list[tuple[int, str]]:
        """(sign, OVER clause) of what is left of the frame; an empty clause is the row itself."""
        low, high = _bound(spec.start), _bound(spec.end)
        by_groups = spec.unit == "groups" or (spec.unit == "range" and all(b is not None and (not b or abs(b) == float("inf")) for b in (low, high)))
        peers = ", ".join(x for x in (spec.partition, self.rank(spec)) if x)
        if by_groups or (spec.unit == "rows" and spec.exclude == "current row"):
            if low is None or high is None:
                raise _unsupported(f"EXCLUDE beside the bounds {spec.start} and {spec.end}")
            order, unit = (self.rank(spec), "range") if by_groups else (spec.order, "rows")
            if low > 0 or high < 0:  # the row's own group isn't in the frame
                return [(1, self.over(spec.partition, order, f"{unit} between {spec.start} and {spec.end}"))]
            out = []
            if low < 0:
                out.append((1, self.over(spec.partition, order, f"{unit} between {spec.start} and 1 preceding")))
            if high > 0:
                out.append((1, self.over(spec.partition, order, f"{unit} between 1 following and {spec.end}")))
            if by_groups and spec.exclude == "ties":
                out.append((1, ""))
            if by_groups and spec.exclude == "current row":
                within = self.column("row_number()" + self.over(peers, self.rank(spec), ""))
                out.append((1, self.over(peers, within, "rows between unbounded preceding and 1 preceding")))
                out.append((1, self.over(peers, within, "rows between 1 following and unbounded following")))
            return out
        if spec.unit == "rows":
            # the peers in a frame of rows are the same frame among the peers alone
            order = self.rank(spec, "row_number") if spec.order else self.column("row_number()" + self.over(spec.partition, "1", ""))
            frame = f"rows between {spec.start} and {spec.end}"
            out = [(1, self.over(spec.partition, order, frame)), (-1, self.over(peers, order, frame))]
        else:
            if not re.search("preceding|current", spec.start) or not re.search("following|current", spec.end):
                return [(1, self.over(spec.partition, spec.order, f"range between {spec.start} and {spec.end}"))]
            out = [(1, self.over(spec.partition, spec.order, f"range between {spec.start} and {spec.end}"))]
            out.append((-1, "" if spec.exclude == "current row" else self.over(peers, "", "")))
        if spec.exclude == "ties":
            out.append((1, ""))
        return out

    def put_together(self, name: str, args: str, spec: Spec) -> str:
        pieces = self.pieces(spec)
        if name not in ("sum", "total", "count", "avg", "min", "max") or (name in ("min", "max") and any(s < 0 for s, _ in pieces)):
            raise _unsupported(f"EXCLUDE with {name} and {spec.unit.upper()}")
        star = args.strip() == "*"
        counts = " ".join(f"{'+' if s > 0 else '-'} " + (f"count({args}){o}" if o else "1" if star else f"(case when ({args}) is null then 0 else 1 end)") for s, o in pieces) or "+ 0"
        if name == "count":
            return f"(0 {counts})"
        if name in ("min", "max"):
            values = [f"{name}({args}){o}" if o else f"({args})" for _, o in pieces]
            fold = "least" if name == "min" else "greatest"
            return f"{fold}({', '.join(values)})" if len(values) > 1 else values[0] if values else f"nullif({args}, {args})"
        sums = " ".join(f"{'+' if s > 0 else '-'} coalesce(" + (f"sum({args}){o}" if o else f"({args})") + ", 0)" for s, o in pieces) or "+ 0"
        if name == "total":
            return f"cast(0 {sums} as double)"
        whole = f"(case when (0 {counts}) = 0 then null else (0 {sums}) end)"
        return whole if name == "sum" else f"(cast({whole} as double) / nullif(0 {counts}, 0))"


def _span(ts: list[Token], i: int) -> tuple[int, int]:
    """The select around token i: its first token, and the one after its last."""
    depth, low, start = 0, 0, None
    for j in range(i, -1, -1):
        depth += (ts[j].text == ")") - (ts[j].text == "(")
        low = min(low, depth)
        if ts[j].low == "select" and depth <= low:
            start = j
            break
    if start is None:
        raise EngineError(errors.SQL, "A window stands outside any SELECT")
    depth = 0
    for j in range(start, len(ts)):
        if not depth and (ts[j].text == ")" or ts[j].low in _SET and not (ts[j].low == "except" and ts[j - 1].text == "*")):
            return start, j
        depth += (ts[j].text == "(") - (ts[j].text == ")")
    return start, len(ts)


def _clauses(ts: list[Token]) -> dict[str, list[Token]]:
    out, now, depth, k = {"select": []}, "select", 0, 1
    while k < len(ts):
        t = ts[k]
        depth += (t.text == "(") - (t.text == ")")
        if not depth and t.low in _CLAUSES and not (t.low == "offset" and now == "limit") and not (t.low == "from" and now != "select"):
            now = t.low
            out[now] = []
        else:
            out[now].append(t)
        k += 1
    return out


def _windows(ts: list[Token]) -> dict[str, list[Token]]:
    """What a WINDOW clause names."""
    solid, out, k = [t for t in ts if not t.blank], {}, 0
    whole = list(ts)
    while k < len(solid):
        name = solid[k].low
        at = whole.index(solid[k + 2])
        end = _closing(whole, at)
        out[name] = whole[at + 1 : end]
        k = next((j + 1 for j in range(k + 2, len(solid)) if solid[j] is whole[end]), len(solid))
        if k < len(solid) and solid[k].text == ",":
            k += 1
    return out


def _rewritten(ts: list[Token], block: Block, named: dict[str, list[Token]]) -> str:
    """Tokens with each odd window call in Spark's frames."""
    out: list[Token | str] = []
    i = 0
    while i < len(ts):
        t = ts[i]
        if t.low != "over":
            out.append(t)
            i += 1
            continue
        j = next(k for k in range(i + 1, len(ts)) if not ts[k].blank)
        if ts[j].text == "(":
            end = _closing(ts, j)
            inner = ts[j + 1 : end]
            solid = [x for x in inner if not x.blank]
            if solid and solid[0].low in named:  # a window that starts from a named one
                at = inner.index(solid[0])
                inner = [*named[solid[0].low], Token("space", " ", 0), *inner[at + 1 :]]
        else:
            end, inner = j, named.get(ts[j].low, [])
        if not _odd(inner):
            out += ts[i : end + 1]
            i = end + 1
            continue
        while out and isinstance(out[-1], Token) and out[-1].blank:
            out.pop()
        depth, k = 0, len(out)
        while k:
            k -= 1
            x = out[k].text if isinstance(out[k], Token) else ""
            depth += (x == ")") - (x == "(")
            if not depth:
                break
        if not k or not isinstance(out[k - 1], Token) or out[k - 1].kind != "word" or out[k - 1].low in ("where", "over"):
            raise _unsupported("FILTER beside a GROUPS frame or EXCLUDE")
        args = "".join(x.text if isinstance(x, Token) else x for x in out[k + 1 : -1])
        name = out[k - 1].text
        del out[k - 1 :]
        out.append(block.call(name, args, parsed(text_of(inner))))
        i = end + 1
    return "".join(x.text if isinstance(x, Token) else x for x in out)


def rewrite_frames(sql: str) -> str:
    """The text with every select that has a GROUPS frame or EXCLUDE as a pipe over its source."""
    for number in range(1000):
        ts = tokens(sql)
        spot = next((i for i, t in enumerate(ts) if t.low in ("groups", "exclude") and _in_window(ts, i)), None)
        if spot is None:
            return sql
        start, end = _span(ts, spot)
        parts = _clauses(ts[start:end])
        if "group" in parts or "having" in parts or any(t.low == "distinct" for t in parts["select"][:3]):
            raise _unsupported("A GROUPS frame or EXCLUDE beside GROUP BY, HAVING or DISTINCT")
        named = _windows(parts.get("window", []))
        block = Block(number)
        items = _rewritten(parts["select"], block, named)
        alone = not any(t.low in _SET for t in ts[end : end + 2]) and not any(t.low in _SET for t in ts[:start])
        tail = {k: text_of(parts[k]) for k in ("order", "limit", "offset") if k in parts}
        if "order" in tail:
            tail["order"] = _rewritten(parts["order"], block, named)
        source = f"from {text_of(parts['from']).strip()}" if "from" in parts else "from (select 1)"
        # ranks may be ordered by what is extended before them, so each has a step of its own
        steps = [source, *([f"where {text_of(parts['where']).strip()}"] if "where" in parts else []), *(f"extend {e} as {c}" for e, c in block.extra.items())]
        if star := re.fullmatch(r"(?s)\s*\*\s*(,.*)?", items):
            items = f" * except ({', '.join(block.extra.values())}){star[1] or ''}" if block.extra else items
        plain = {k: v for k, v in named.items() if not _odd(v)}
        window = f" window {', '.join(f'{k} as ({text_of(v)})' for k, v in plain.items())}" if plain else ""
        if window:
            raise _unsupported("A named window beside one with a GROUPS frame or EXCLUDE")
        steps.append(f"select{items.rstrip()}")
        ends = "".join(f" {'order' if k == 'order' else k}{v}" for k, v in tail.items())
        if alone and tail:
            if "order" in tail:
                steps.append(f"order{tail['order'].rstrip()}")
            if "limit" in tail:
                steps.append(f"limit{tail['limit'].rstrip()}")
            ends = ""
        sql = text_of(ts[:start]) + ("(" if not alone else "") + " |> ".join(steps) + (")" if not alone else "") + ends + " " + text_of(ts[end:])
    return sql


def _in_window(ts: list[Token], i: int) -> bool:
    """Whether the word at i belongs to a frame: inside the parentheses of OVER or of a named window."""
    depth = 0
    for j in range(i, -1, -1):
        depth += (ts[j].text == ")") - (ts[j].text == "(")
        if depth < 0:
            before = [t for t in ts[:j] if not t.blank][-1:]
            inner = ts[j + 1 : _closing(ts, j)]
            return bool(before) and before[0].low in ("over", "as") and _odd(inner)
    return False
