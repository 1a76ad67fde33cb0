"""Rows as delimited text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom import errors
from textloom.errors import EngineError
from textloom.options import WriteOptions


def plain(value) -> str:  # noqa: ANN001
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    return str(value)


def quote(text: str, is_text: bool, options: WriteOptions) -> str:
    """none: as it is; minimal: where the text would be misread; nonnumeric: all text; all: everything."""
    mode = options.quoting
    if mode == "none":
        return text
    needs = mode == "all" or (mode == "nonnumeric" and is_text) or (mode == "minimal" and is_text and any(c in text for c in (options.delimiter, "\n", "\r", '"')))
    return '"' + text.replace('"', '""') + '"' if needs else text


def quoted_column(c: Column, kind: str, options: WriteOptions) -> Column:
    """quote() as an expression, for part files written by executors."""
    if kind == "boolean":
        c = c.cast("int")
    s = F.coalesce(c.cast("string"), F.lit(""))
    wrapped = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    if options.quoting == "all" or (options.quoting == "nonnumeric" and kind == "string"):
        return F.when(c.isNull(), F.lit("")).otherwise(wrapped) if options.quoting != "all" else wrapped
    if options.quoting == "none" or kind != "string":
        return s
    odd = F.contains(s, F.lit(options.delimiter)) | F.contains(s, F.lit('"')) | F.contains(s, F.lit("\n")) | F.contains(s, F.lit("\r"))
    return F.when(odd, wrapped).otherwise(s)


def parse_formats(text: str | None) -> dict[int, str]:
    """`1={:4.3f},2={}`: Python formats by column number."""
    if not text:
        return {}
    out = {}
    for part in re.split(r",(?=\s*\d+=)", text):
        number, eq, form = part.partition("=")
        if not eq or not number.strip().isdigit():
            raise EngineError(errors.FORMAT, f"Cannot read the column format '{part}'")
        out[int(number)] = form
    return out


def lines(rows: Iterable[tuple], names: list[str], options: WriteOptions) -> Iterator[str]:
    """The header, if asked for, and each row. Beautifying needs all rows at once for the widths; nothing else does."""
    formats = parse_formats(options.formats)

    def cells(row: tuple) -> list[str]:
        out = []
        for i, v in enumerate(row, 1):
            if i in formats and v is not None:
                try:
                    text = formats[i].format(v)
                except (ValueError, IndexError, KeyError) as e:
                    raise EngineError(errors.FORMAT, f"Cannot format column {i}: {e}") from None
            else:
                text = plain(v)
            out.append("" if v is None and options.quoting != "all" else quote(text, isinstance(v, str), options))
        return out

    body = map(cells, rows)
    head = [[quote(n, True, options) for n in names]] if options.header else []
    if options.beautify:
        table = head + list(body)
        widths = [max(map(len, c)) for c in zip(*table, strict=True)] if table else []
        for row in table:
            yield options.delimiter.join(x.ljust(w) for x, w in zip(row, widths, strict=True))
        return
    for row in (*head, *()):
        yield options.delimiter.join(row)
    for row in body:
        yield options.delimiter.join(row)
