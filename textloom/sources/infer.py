"""Names and types of columns from a sample of rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from textloom import errors
from textloom.errors import EngineError

#: The column of an empty table without a header.
EMPTY_COLUMN = "dummy_column_for_empty_tables"
_INT = re.compile(r"\s*[+-]?[0-9]+\s*\Z")
_REAL = re.compile(r"\s*[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*\Z")
SPARK_TYPES = {"int": "bigint", "real": "double", "text": "string"}


def kind_of(value: str) -> str:
    """int, real or text; integers beyond 64 bits are real, and neither `1_000`, `nan` nor `inf` is a number."""
    if _INT.match(value):
        return "int" if -(1 << 63) <= int(value) < 1 << 63 else "real"
    return "real" if _REAL.match(value) else "text"


def column_kind(values: list[str | None]) -> str:
    """All integers: int; integers and reals: real; else, or if all are empty, text."""
    kinds = {kind_of(v) for v in values if v}
    if not kinds or "text" in kinds:
        return "text"
    return "real" if "real" in kinds else "int"


@dataclass
class Schema:
    names: list[str]
    kinds: list[str]
    sample: list[list[str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def ddl(self) -> str:
        return ", ".join(f"`{n.replace('`', '``')}` {SPARK_TYPES[k]}" for n, k in zip(self.names, self.kinds, strict=True))


def check_header(names: list[str], delimiter: str) -> None:
    """Names must be usable and different."""
    for name in names:
        if not name.strip():
            raise EngineError(errors.BAD_HEADER, "Header has an empty column name")
        if name != name.strip():
            raise EngineError(errors.BAD_HEADER, f"Header name '{name}' begins or ends with a space")
        if any(c in name for c in (",", "\n", "\r", "\0")) or (delimiter != " " and delimiter in name):
            raise EngineError(errors.BAD_HEADER, f"Header name '{name}' has a character that isn't allowed")
        if kind_of(name) != "text":
            raise EngineError(errors.BAD_HEADER, f"Header name '{name}' is a number; is this a header?")
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise EngineError(errors.BAD_HEADER, f"Header has duplicate names: {', '.join(twice)}")


def infer(rows: list[list[str]], header: list[str] | None, options) -> Schema:  # noqa: ANN001
    """From up to sample_rows rows after the header."""
    opts, warnings = options, []
    widths = [len(r) for r in rows]
    if opts.mode == "strict" and (wrong := sorted(set(widths) - ({opts.columns} if opts.columns else {max(widths, default=0)}))):
        raise EngineError(errors.COLUMN_COUNT, f"Strict mode: column counts differ; expected {opts.columns or max(widths)}, found also {', '.join(map(str, wrong))}")
    n = opts.columns or max(widths, default=0)
    if not n and header is None:
        return Schema([EMPTY_COLUMN], ["text"], warnings=["Data is empty"])
    if header is None:
        names = [f"c{i + 1}" for i in range(n)]
    else:
        n = n or len(header)
        check_header(header, opts.delimiter)
        if len(header) != n and rows and opts.mode == "strict":
            raise EngineError(errors.COLUMN_COUNT, f"Strict mode: the header has {len(header)} columns and the data {n}")
        names = header[:n] + [f"c{i + 1}" for i in range(len(header), n)]
        if not rows:
            warnings.append("Data is empty")
    full = [fitted(r, n, opts.delimiter) for r in rows]
    columns = [[r[i] for r in full] for i in range(n)]
    kinds = ["text"] * n if opts.as_text else [column_kind(c) for c in columns]
    if header is None and len(rows) > 1 and n and not opts.as_text:
        rest = [column_kind(c[1:]) for c in columns]
        if all(k == "text" for k in kinds) and any(k != "text" for k in rest):
            warnings.append("There seems to be a header line in the file, but the header option isn't used; all columns are text")
    if n == 1 and opts.columns not in (None, 1):
        warnings.append("Column count is one; is the delimiter right?")
    return Schema(names, kinds, rows, warnings)


def fitted(row: list[str], n: int, delimiter: str) -> list[str | None]:
    """A short row is padded with nulls, and what a long one has too much joined into the last column."""
    if len(row) == n:
        return row  # type: ignore[return-value]
    if len(row) < n:
        return [*row, *[None] * (n - len(row))]
    return [*row[: n - 1], delimiter.join(row[n - 1 :])]


def convert(value: str | None, kind: str):  # noqa: ANN201
    """The value in its column's type; empty numbers are null. Columns with values that fit no number are text before it comes to this."""
    if value is None or kind == "text":
        return value
    if kind == "int":
        return int(value) if _INT.match(value) and -(1 << 63) <= int(value) < 1 << 63 else None
    return float(value) if _REAL.match(value) else None
