"""How a table is read and a result written."""

from __future__ import annotations

import codecs
import csv
from dataclasses import dataclass, fields, replace

from textloom import errors
from textloom.errors import EngineError


@dataclass(frozen=True)
class ReadOptions:
    """The dialect of delimited text and what is inferred from it. Both quoting conventions are on unless turned off."""

    delimiter: str = " "
    header: bool = False
    keep_leading_space: bool = False
    quoting: str = "minimal"  # minimal, all, none
    double_quote_escape: bool = True
    backslash_escape: bool = True
    mode: str = "relaxed"  # relaxed, strict
    columns: int | None = None
    encoding: str = "utf-8"
    gzipped: bool = False
    as_text: bool = False
    max_field: int = 131072
    sample_rows: int = 100
    full_scan_inference: bool = False
    cache: str = "none"  # none, read, readwrite
    overwrite_cache: bool = False

    def checked(self) -> ReadOptions:
        if len(self.delimiter) != 1:
            raise EngineError(errors.DELIMITER, "Delimiter must be one character only")
        if self.quoting not in ("minimal", "all", "none"):
            raise EngineError(errors.INPUT_QUOTING, f"Unsupported input quoting mode: {self.quoting}")
        if self.mode not in ("relaxed", "strict"):
            raise EngineError(errors.PARSING_MODE, f"Parsing mode must be relaxed or strict, not {self.mode}")
        if self.columns is not None and not 1 <= self.columns <= 100_000:
            raise EngineError(errors.COLUMN_RANGE, "Column count is out of range")
        if not isinstance(self.max_field, int) or self.max_field < 3:
            raise EngineError(errors.FIELD_SIZE, f"Maximum field length must be an integer of 3 or more, not {self.max_field}")
        if self.cache not in ("none", "read", "readwrite"):
            raise EngineError(errors.TABLE_MISSING, f"Caching mode must be none, read or readwrite, not {self.cache}")
        try:
            codecs.lookup(self.encoding)
        except LookupError:
            raise EngineError(errors.UNKNOWN_ENCODING, f"Encoding {self.encoding} is not supported") from None
        return self

    def merged(self, **changes) -> ReadOptions:  # noqa: ANN003
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in changes.items() if k in known and v is not None})

    def dialect(self) -> dict:
        """Arguments of csv.reader."""
        return {
            "delimiter": self.delimiter,
            "skipinitialspace": not self.keep_leading_space,
            "quoting": {"minimal": csv.QUOTE_MINIMAL, "all": csv.QUOTE_ALL, "none": csv.QUOTE_NONE}[self.quoting],
            "quotechar": '"',
            "doublequote": self.double_quote_escape,
            "escapechar": "\\" if self.backslash_escape else None,
        }


@dataclass(frozen=True)
class WriteOptions:
    """How rows become delimited text."""

    delimiter: str = " "
    header: bool = False
    quoting: str = "minimal"  # none, minimal, nonnumeric, all
    formats: str | None = None  # "1={:4.3f},2={:d}"
    beautify: bool = False
    encoding: str = "utf-8"

    def checked(self) -> WriteOptions:
        if self.quoting not in ("none", "minimal", "nonnumeric", "all"):
            raise EngineError(errors.OUTPUT_QUOTING, f"Unsupported output quoting mode: {self.quoting}")
        if len(self.delimiter) != 1:
            raise EngineError(errors.DELIMITER, "Output delimiter must be one character only")
        return self
