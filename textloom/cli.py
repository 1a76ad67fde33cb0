"""The command line: textloom [options] "SELECT ... FROM file"."""

from __future__ import annotations

import argparse
import configparser
import locale
import logging
import os
import sys

from textloom import __version__, errors
from textloom.errors import EngineError, translated
from textloom.functions.dialect import DESCRIPTIONS
from textloom.options import ReadOptions, WriteOptions

#: Option names with their defaults; a config file's [options] may set any.
DEFAULTS: dict[str, object] = {
    "header": False, "delimiter": None, "tab_delimited": False, "pipe_delimited": False, "encoding": "utf-8", "gzipped": False, "analyze_only": False,
    "mode": "relaxed", "column_count": None, "keep_leading_whitespace": False, "disable_double_double_quoting": False, "disable_escaped_double_quoting": False,
    "as_text": False, "input_quoting_mode": "minimal", "max_column_length_limit": 131072, "universal_newlines": False, "caching_mode": "none", "full_scan_inference": False,
    "output_delimiter": None, "tab_delimited_output": False, "pipe_delimited_output": False, "output_header": False, "beautify": False, "formatting": None, "output_encoding": None,
    "output_quoting_mode": "minimal", "query_filename": None, "query_encoding": None, "save_db_to_disk": None, "list_user_functions": False, "verbose": False, "no_compat": False,
    "overwrite_cache": False, "max_attached_databases": 10, "master": None,
}


def rc_files(environ: dict) -> list[str]:
    named = environ.get("TEXTLOOMRC")
    if named == "None":
        return []
    if named:
        if not os.path.exists(named):
            raise EngineError(errors.RC_MISSING, f"Config file {named} doesn't exist")
        return [named]
    return [p for p in (os.path.expanduser("~/.textloomrc"), ".textloomrc") if os.path.exists(p)]


def configured(environ: dict) -> dict:
    """Defaults under those of the config files; later files win."""
    parser = configparser.ConfigParser(interpolation=None)
    out = dict(DEFAULTS)
    for path in rc_files(environ):
        try:
            parser.read(path)
        except configparser.Error as e:
            raise EngineError(errors.OTHER, f"Cannot read config file {path}: {e}") from None
    if parser.has_section("options"):
        for key, value in parser["options"].items():
            if key not in out:
                continue
            if isinstance(DEFAULTS[key], bool):
                if value.lower() not in ("true", "false", "1", "0", "yes", "no"):
                    raise EngineError(errors.OTHER, f"Config option {key} must be true or false, not {value}")
                out[key] = value.lower() in ("true", "1", "yes")
            elif isinstance(DEFAULTS[key], int) or key == "column_count":
                try:
                    out[key] = int(value)
                except ValueError:
                    raise EngineError(errors.OTHER, f"Config option {key} must be a number, not {value}") from None
            else:
                out[key] = value
    return out


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:  # type: ignore[override]
        raise EngineError(errors.SQL, message)


def parser(defaults: dict) -> argparse.ArgumentParser:
    p = _Parser(prog="textloom", description="SQL over text, SQLite and Parquet files on Spark", add_help=True)

    def flag(*names: str, dest: str, text: str) -> None:
        p.add_argument(*names, dest=dest, action="store_true", default=defaults[dest], help=text)

    def value(*names: str, dest: str, text: str, kind=str) -> None:  # noqa: ANN001
        p.add_argument(*names, dest=dest, type=kind, default=defaults[dest], help=text)

    p.add_argument("queries", nargs="*", help="SQL; several run in order until one fails")
    p.add_argument("-v", "--version", action="store_true")
    p.add_argument("--dump-defaults", action="store_true", help="print the options as a config file")
    flag("-V", "--verbose", dest="verbose", text="show tracebacks")
    flag("-L", "--list-user-functions", dest="list_user_functions", text="list the dialect's functions")
    value("-S", "--save-db-to-disk", dest="save_db_to_disk", text="write the query's tables to a SQLite file (or, with a trailing slash, to Parquet) instead of running it")
    value("-C", "--caching-mode", dest="caching_mode", text="none, read or readwrite")
    flag("--overwrite-cache", dest="overwrite_cache", text="with -C readwrite: write the cache anew")
    flag("-H", "--skip-header", dest="header", text="the first line has the column names")
    value("-d", "--delimiter", dest="delimiter", text="input delimiter (default: space)")
    flag("-t", "--tab-delimited", dest="tab_delimited", text="input delimited by tabs")
    flag("-p", "--pipe-delimited", dest="pipe_delimited", text="input delimited by pipes")
    value("-e", "--encoding", dest="encoding", text="input encoding")
    flag("-z", "--gzipped", dest="gzipped", text="input is gzip-compressed, whatever its name")
    flag("-A", "--analyze-only", dest="analyze_only", text="print columns and types from a sample")
    value("-m", "--mode", dest="mode", text="relaxed or strict about column counts")
    value("-c", "--column-count", dest="column_count", text="number of columns", kind=int)
    flag("-k", "--keep-leading-whitespace", dest="keep_leading_whitespace", text="keep blanks before values")
    flag("--disable-double-double-quoting", dest="disable_double_double_quoting", text='"" inside quotes is no quote')
    flag("--disable-escaped-double-quoting", dest="disable_escaped_double_quoting", text='\\" is no quote')
    flag("--as-text", dest="as_text", text="all columns are text")
    flag("--full-scan-inference", dest="full_scan_inference", text="infer types from all rows")
    value("-w", "--input-quoting-mode", dest="input_quoting_mode", text="minimal, all or none")
    value("-M", "--max-column-length-limit", dest="max_column_length_limit", text="longest field")
    flag("-U", "--with-universal-newlines", dest="universal_newlines", text="accepted; newlines of all kinds are always read")
    value("-D", "--output-delimiter", dest="output_delimiter", text="output delimiter (default: the input's)")
    flag("-T", "--tab-delimited-output", dest="tab_delimited_output", text="output delimited by tabs")
    flag("-P", "--pipe-delimited-output", dest="pipe_delimited_output", text="output delimited by pipes")
    flag("-O", "--output-header", dest="output_header", text="print column names")
    flag("-b", "--beautify", dest="beautify", text="align columns")
    value("-f", "--formatting", dest="formatting", text="1={:4.3f},2=... by column number")
    value("-E", "--output-encoding", dest="output_encoding", text="output encoding (default: the terminal's)")
    value("-W", "--output-quoting-mode", dest="output_quoting_mode", text="none, minimal, nonnumeric or all")
    value("-q", "--query-filename", dest="query_filename", text="read the query from a file")
    value("-Q", "--query-encoding", dest="query_encoding", text="encoding of queries")
    value("--max-attached-sqlite-databases", dest="max_attached_databases", text="accepted; any number may be used", kind=int)
    flag("--no-compat", dest="no_compat", text="plain Spark SQL but for file names")
    value("--master", dest="master", text="Spark master (default: local[*])")
    return p


def read_options(o: argparse.Namespace, warn) -> ReadOptions:  # noqa: ANN001
    delimiter = o.delimiter
    for on, char, name in ((o.tab_delimited, "\t", "-t"), (o.pipe_delimited, "|", "-p")):
        if on:
            if o.delimiter is not None and o.delimiter != char:
                warn(f"Warning: {name} overrides -d {o.delimiter}")
            delimiter = char
    try:
        longest = int(o.max_column_length_limit)
    except (TypeError, ValueError):
        raise EngineError(errors.FIELD_SIZE, f"Maximum column length must be a number, not {o.max_column_length_limit}") from None
    if o.max_attached_databases <= 3:
        raise EngineError(errors.ATTACH_LIMIT, "The number of attached databases must be above 3")
    return ReadOptions(
        delimiter=" " if delimiter is None else delimiter, header=o.header, keep_leading_space=o.keep_leading_whitespace, quoting=o.input_quoting_mode,
        double_quote_escape=not o.disable_double_double_quoting, backslash_escape=not o.disable_escaped_double_quoting, mode=o.mode, columns=o.column_count,
        encoding=o.encoding, gzipped=o.gzipped, as_text=o.as_text, max_field=longest, full_scan_inference=o.full_scan_inference, cache=o.caching_mode, overwrite_cache=o.overwrite_cache,
    ).checked()


def write_options(o: argparse.Namespace, read: ReadOptions, warn) -> WriteOptions:  # noqa: ANN001
    delimiter = o.output_delimiter if o.output_delimiter is not None else read.delimiter
    for on, char, name in ((o.tab_delimited_output, "\t", "-T"), (o.pipe_delimited_output, "|", "-P")):
        if on:
            if o.output_delimiter is not None and o.output_delimiter != char:
                warn(f"Warning: {name} overrides -D {o.output_delimiter}")
            delimiter = char
    encoding = o.output_encoding or getattr(sys.stdout, "encoding", None) or locale.getpreferredencoding(False) or "utf-8"
    return WriteOptions(delimiter, o.output_header, o.output_quoting_mode, o.formatting, o.beautify, encoding).checked()


def query_texts(o: argparse.Namespace) -> list[str]:
    if o.query_filename and o.queries:
        raise EngineError(errors.SQL, "A query file and a query on the command line exclude each other")
    if o.query_encoding and not o.query_filename and not o.queries:
        raise EngineError(errors.SQL, "A query encoding needs a query")
    if o.query_filename:
        try:
            with open(o.query_filename, "rb") as f:
                return [f.read().decode(o.query_encoding or "utf-8")]
        except OSError:
            raise EngineError(errors.SQL, f"Could not read query file {o.query_filename}") from None
        except (UnicodeError, LookupError):
            raise EngineError(errors.ENCODE, f"Could not decode the query in {o.query_filename} as {o.query_encoding or 'utf-8'}") from None
    if not o.queries:
        raise EngineError(errors.SQL, "A query is missing; see --help")
    if not all(q.strip() for q in o.queries):
        raise EngineError(errors.SQL, "A query is empty")
    return o.queries


def print_analysis(result, write) -> None:  # noqa: ANN001
    for info in result.tables.values():
        write(f"Table: {info.name}")
        write("  Sources:")
        for source in info.sources:
            write(f"    source_type: {info.source_type} source: {source}")
        write("  Fields:")
        for name, kind in info.columns:
            write(f"    `{name}` - {kind}")


def main(argv: list[str] | None = None, spark=None, stdin=None, stdout=None, stderr=None) -> int:  # noqa: ANN001
    """Run, and return the exit code."""
    err = stderr or sys.stderr
    out = stdout or sys.stdout.buffer
    verbose = False

    def warn(text: str) -> None:
        print(text, file=err)

    try:
        defaults = configured(dict(os.environ))
        o = parser(defaults).parse_args(argv)
        verbose = o.verbose
        if o.version:
            print(f"textloom {__version__}", file=err)
            return 0
        if o.dump_defaults:
            out.write(("[options]\n" + "".join(f"{k}={'' if v is None else v}\n" for k, v in sorted(defaults.items()))).encode())
            return 0
        if o.list_user_functions:
            out.write("".join(f"{k}: {v}\n" for k, v in DESCRIPTIONS.items()).encode())
            return 0
        read = read_options(o, warn)
        write = write_options(o, read, warn)
        try:
            "".encode(write.encoding)
        except LookupError:
            raise EngineError(errors.OUTPUT_STREAM, f"Cannot write in encoding {write.encoding}") from None
        if o.save_db_to_disk:
            if o.analyze_only:
                raise EngineError(errors.SAVE_WITH_ANALYZE, "Saving and analyzing exclude each other")
            if os.path.exists(o.save_db_to_disk):
                raise EngineError(errors.TARGET_EXISTS, f"Target {o.save_db_to_disk} exists already")
        texts = query_texts(o)

        from textloom.engine import Engine
        from textloom.operators import render
        from textloom.session import session

        logging.getLogger("SQLQueryContextLogger").disabled = True  # failures are told below, once
        made = spark or session(o.master or "local[*]", **{"spark.log.level": "ERROR", "spark.ui.enabled": "false"})
        with Engine(made, read, {"-": stdin or sys.stdin.buffer}, compat=not o.no_compat) as engine:
            for text in texts:
                if o.save_db_to_disk:
                    warn(f"Tables are saved to {o.save_db_to_disk}; the query over them: {engine.save(text, o.save_db_to_disk)}")
                    continue
                result = engine.execute(text, sample_only=o.analyze_only)
                for w in result.warnings:
                    warn(f"Warning: {w}")
                if result.error:
                    raise result.error
                if o.analyze_only:
                    result.rows()
                    print_analysis(result, lambda x: out.write((x + "\n").encode(write.encoding)))
                    continue
                rows = (tuple(r) for r in result.frame.toLocalIterator(prefetchPartitions=True))
                for line in render.lines(rows, result.columns, write):
                    try:
                        out.write((line + "\n").encode(write.encoding))
                    except UnicodeEncodeError as e:
                        raise EngineError(errors.ENCODE, f"Cannot encode the output as {write.encoding}: {e}") from None
        out.flush()
        return 0
    except BrokenPipeError:
        return 0
    except SystemExit as e:
        return int(e.code or 0)
    except Exception as e:  # noqa: BLE001
        failure = translated(e)
        if verbose:
            import traceback

            traceback.print_exc(file=err)
        name = "query error" if failure.code == errors.SQL else "error"
        print(f"{name}: {failure.message}", file=err)
        return failure.code


if __name__ == "__main__":
    sys.exit(main())
