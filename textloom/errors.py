"""Failures with the exit codes that callers rely on."""

from __future__ import annotations

import re

OK, SQL, COLUMN_COUNT, ENCODE, FORMAT, DELIMITER = 0, 1, 2, 3, 4, 5
UNKNOWN_ENCODING, PARSING_MODE, FILE_MISSING, FIELD_SIZE, BAD_HEADER, GZ_STDIN = 10, 13, 30, 31, 35, 36
INPUT_QUOTING, OUTPUT_QUOTING, NUMERIC, DECODE, TARGET_EXISTS = 55, 56, 58, 59, 77
CACHE_DIFFERS, CACHE_SAMPLE_DIFFERS, TOO_MANY_FILES, CACHE_TABLE_MISSING, TABLE_MISSING = 80, 81, 82, 84, 85
CACHE_AMBIGUOUS, TABLE_AMBIGUOUS, NO_TABLES, COLUMN_RANGE, NOT_UNICODE = 86, 87, 88, 90, 91
UNKNOWN_TYPE, CACHE_EMPTY, ATTACH_LIMIT, HEADER_MISSING, NO_TABLE, SAVE_WITH_ANALYZE = 95, 97, 99, 117, 118, 119
OTHER, OUTPUT_STREAM, RC_MISSING = 199, 200, 244

_TAG = re.compile(r"TEXTLOOM\[(\d+)\] (.*)")


class EngineError(Exception):
    """A failure with its exit code; its text survives the way from an executor to the driver."""

    def __init__(self, code: int, message: str) -> None:
        super().__init__(f"TEXTLOOM[{code}] {message}")
        self.code, self.message = code, message

    def __reduce__(self):  # noqa: ANN204
        return EngineError, (self.code, self.message)


def translated(error: Exception) -> EngineError:
    """Any exception as an EngineError: one raised on an executor by its tag, an encoding failure or Spark's own by kind."""
    from pyspark.errors import AnalysisException, PySparkException

    if isinstance(error, EngineError):
        return error
    if isinstance(error, AnalysisException):  # its text may quote a plan, tags and all
        return EngineError(SQL, str(error).splitlines()[0])
    if m := _TAG.search(str(error)):
        return EngineError(int(m[1]), m[2].strip())
    if isinstance(error, PySparkException):
        return EngineError(SQL, str(error).splitlines()[0])
    return EngineError(OTHER, f"{type(error).__name__}: {error}")
