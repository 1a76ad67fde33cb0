"""Delimited text as lazy DataFrames.

The dialect is that of Python's csv module (runs of blanks skipped after a
delimiter, both quoting conventions, quoted newlines, text after a closing
quote), with ragged rows padded or folded into the last column. Spark's CSV
reader differs from it in all of these, so there are two ways:

* Lines: a text without any quote or backslash has one record a line. Spark
  reads and splits such files anywhere, whatever their size; fields are cut by
  JVM expressions that the optimiser prunes to the columns in use.
* Records: otherwise a quoted newline may straddle any split, so a first pass
  finds what each split starts inside of (see `blocks`), and the splits are
  parsed by csv in Arrow batches, each by a task of its own. Only other
  encodings than UTF-8 are read a file at a time.

Which way holds is decided by one JVM scan for those characters (kept by
file, size and time), never by size. The same pass looks whether every value
fits the type that the first rows suggest; a column with one that doesn't is
wider, so no value is lost.
"""

from __future__ import annotations

import csv
import gzip
import io
import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import errors
from textloom.errors import EngineError
from textloom.options import ReadOptions
from textloom.sources import blocks, files
from textloom.sources.infer import SPARK_TYPES, Schema, convert, fitted, infer

SAMPLE_BYTES = 1 << 20
#: Rows of a stream that the driver holds at a time.
STREAM_ROWS = 200_000
BATCH_ROWS = 5_000
SUFFIX = ".tlcache"
#: What one pass over files has told, by their names, sizes and times: whether lines are records, and types that all values fit.
_plain: dict[tuple, bool] = {}
_fits: dict[tuple, list[str]] = {}
_blocks: dict[tuple, blocks.Map] = {}


def records(stream: io.TextIOBase, options: ReadOptions, name: str) -> Iterator[list[str]]:
    """csv rows; a field that is too long and a faulty record become EngineErrors."""
    csv.field_size_limit(options.max_field)
    reader = csv.reader(stream, **options.dialect())
    try:
        yield from reader
    except csv.Error as e:
        if "field larger" in str(e):
            raise EngineError(errors.FIELD_SIZE, f"Column length is larger than the maximum of {options.max_field}, at {name}:{reader.line_num}") from None
        raise EngineError(errors.DECODE, f"Cannot parse {name}:{reader.line_num}: {e}") from None
    except UnicodeError as e:
        raise EngineError(errors.DECODE, f"Cannot decode {name} as {options.encoding}: {e}") from None


def opened(data: bytes, options: ReadOptions, gzipped: bool) -> io.TextIOBase:
    raw: io.IOBase = io.BytesIO(data)
    return io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if gzipped else raw, encoding=options.encoding, newline=None)  # type: ignore[arg-type]


def _first_rows(spark: SparkSession, path: str, options: ReadOptions, n: int) -> list[list[str]]:
    size = SAMPLE_BYTES
    while True:
        data = files.head(spark, path, options.gzipped, size)
        whole = len(data) < size
        if not whole:  # an unfinished record at the cut is left out
            cut = max(data.rfind(b"\n"), data.rfind(b"\r"))
            data = data[: cut + 1] if cut >= 0 else data
        try:
            rows = list(itertools.islice(records(opened(data, options, False), options, path), n + 1 if not whole else n))
        except EngineError:
            if whole or size >= 1 << 28:
                raise
            rows = []
        if whole or len(rows) > n or size >= 1 << 28:
            return rows[:n]
        size *= 8


def sample(spark: SparkSession, paths: list[str], options: ReadOptions) -> tuple[list[str] | None, list[list[str]]]:
    """The header, if any, and the first data rows over all files. Later headers must equal the first."""
    header, rows = None, []
    for k, path in enumerate(paths):
        if len(rows) >= options.sample_rows and not options.header:
            break
        want = max(0, options.sample_rows - len(rows)) + options.header
        got = _first_rows(spark, path, options, max(1, want))
        if options.header:
            if not got:
                if k == 0:
                    raise EngineError(errors.HEADER_MISSING, f"Header line is expected but missing in file {path}")
                continue
            if header is not None and got[0] != header:
                raise EngineError(errors.BAD_HEADER, f"Headers differ: {got[0]} in {path}, {header} in {paths[0]}")
            header, got = got[0], got[1:]
        rows += got[: options.sample_rows - len(rows)]
    return header, rows


def _key(spark: SparkSession, paths: list[str], options: ReadOptions) -> tuple:
    return tuple((p, *files.stamp(spark, p)) for p in paths), options.quoting, options.header, options.backslash_escape


def is_plain(spark: SparkSession, paths: list[str], options: ReadOptions, schema: Schema | None = None) -> bool:
    """Whether each line is a record: UTF-8 without quotes, backslashes or (under a header) blank lines.

    The one pass that decides this also finds which of the schema's numbers fit
    their columns in every row (see `fits`).
    """
    if options.encoding.lower().replace("_", "-") not in ("utf-8", "utf8") or options.quoting == "all" or (options.gzipped and not all(p.endswith(".gz") for p in paths)):
        return False
    key = _key(spark, paths, options)
    if key not in _plain or (schema and _plain[key] and _fits_key(key, options, schema) not in _fits):
        line = F.col("line")
        odd = F.lit(False) if options.quoting == "none" else F.contains(line, F.lit('"'))
        if options.backslash_escape:
            odd = odd | F.contains(line, F.lit("\\"))
        odd = odd | F.contains(line, F.lit("\0")) | F.contains(line, F.lit("\ufeff")) | F.contains(line, F.lit("\ufffd"))
        if options.header:
            odd = odd | (line == "")
        # most texts with quotes show one at once; the rest take one pass, without the small first jobs of take()
        start = files.head(spark, paths[0], options.gzipped, 1 << 16)
        if (b'"' in start and options.quoting != "none") or (b"\\" in start and options.backslash_escape):
            _plain[key] = False
            return False
        checks = [F.coalesce(F.bool_or(odd), F.lit(False)).alias("odd")]
        rows = spark.read.text(paths).withColumnRenamed("value", "line")
        numbers = any(k != "text" for k in schema.kinds) if schema else False
        if numbers:
            own = F.lit(False)
            if options.header:
                # each file's header is no row of numbers; a line equal to one is a row only if there are more of them than files
                heads = {re.split(b"[\r\n]", files.head(spark, p, files.is_gzip(p, options.gzipped), 1 << 20), maxsplit=1)[0].decode("utf-8", "replace") for p in paths}
                own = line.isin(sorted(heads))
                checks.append(F.count_if(own).alias("heads"))
            checks.append(F.coalesce(F.bool_and(own | _fitting_line(options, schema)), F.lit(True)).alias("fit"))
        got = rows.agg(*checks).first()
        _plain[key] = not got["odd"]
        if numbers and not got["odd"]:
            if options.header and got["heads"] > len(paths):
                kinds = ["text"] * len(schema.kinds)
            elif got["fit"]:
                kinds = schema.kinds
            else:  # which columns it is that some value doesn't fit takes a second pass
                text = Schema([f"f{i}" for i in range(len(schema.names))], ["text"] * len(schema.names))
                kinds = _fitting(schema, split_lines(rows.where(~own), options.merged(mode="relaxed", max_field=(1 << 31) - 1), text).agg(*_checks(schema)).first())
            _fits[_fits_key(key, options, schema)] = kinds
    return _plain[key]


def _fitting_line(options: ReadOptions, schema: Schema) -> Column:
    """Whether a line's fields fit the schema's types. One pattern tells it for nearly all lines; others are cut."""
    line, n, d = F.col("line"), len(schema.kinds), options.delimiter
    blank = "[\\t ]*+" if d not in "\t " else ""
    number = {"int": "[+-]?+[0-9]{1,18}+", "real": "[+-]?+(?:[0-9]++(?:\\.[0-9]*+)?+|\\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+"}
    cut = "\\" + d if d in r"\.^$|?*+()[]{}-" else d
    one = {k: f"{blank}(?:{x}{blank})?+" for k, x in number.items()} | {"text": f"[^{cut}]*+"}
    pattern = "^" + (" ++" if d == " " and not options.keep_leading_space else cut).join(one[k] for k in schema.kinds) + "$"
    parts = _parts(options.merged(mode="relaxed", max_field=(1 << 31) - 1), schema)
    codes = F.array(*[F.lit(("text", "int", "real").index(k)) for k in schema.kinds])
    trim = (lambda x: x) if options.keep_leading_space or d == " " else F.ltrim

    def fits_one(x: Column, at: Column) -> Column:
        code = F.get(codes, at)
        number = F.when(code == 1, _typed(x, "int").isNotNull()).when(code == 2, _typed(x, "real").isNotNull()).otherwise(F.lit(True))
        return number | (trim(x) == "")

    cells = F.forall(F.transform(parts, fits_one), lambda x: x)
    enough = F.lit(True) if schema.kinds[-1] == "text" else F.size(parts) <= n  # what is too much makes the last column text
    return line.rlike(pattern) | (line == "") | (cells & enough)


def _fits_key(key: tuple, options: ReadOptions, schema: Schema) -> tuple:
    return key, options.delimiter, options.keep_leading_space, options.columns, tuple(schema.names), tuple(schema.kinds)


def _checks(schema: Schema) -> list[Column]:
    """For each column f0, f1, ... of numbers, whether all that isn't empty is an integer, and whether it is a number."""
    out = []
    for i, kind in enumerate(schema.kinds):
        v = F.col(f"f{i}")
        filled = v.isNotNull() & (v != "")
        out += [F.coalesce(F.bool_and(F.when(filled, _typed(v, k).isNotNull())), F.lit(True)).alias(f"{k}{i}") for k in ("int", "real") if kind == k or (kind == "int" and k == "real")]
    return out


def _fitting(schema: Schema, got) -> list[str]:  # noqa: ANN001
    """The narrowest type at least as wide as the schema's that every value of a column fits."""
    return [k if k == "text" else "int" if k == "int" and got[f"int{i}"] else "real" if got[f"real{i}"] else "text" for i, k in enumerate(schema.kinds)]


def fits(spark: SparkSession, paths: list[str], options: ReadOptions, schema: Schema) -> Schema:
    """The schema with a column of numbers widened, to real or text, if any row has a value that doesn't fit: no value is lost."""
    if all(k == "text" for k in schema.kinds):
        return schema
    if is_plain(spark, paths, options, schema):
        kinds = _fits[_fits_key(_key(spark, paths, options), options, schema)]
    else:
        key = _fits_key(_key(spark, paths, options), options, schema), options.encoding, options.gzipped, options.double_quote_escape
        if key not in _fits:
            names = [f"f{i}" for i in range(len(schema.names))]
            rows = _by_records(spark, paths, options.merged(mode="relaxed"), Schema(names, ["text"] * len(names)))
            _fits[key] = _fitting(schema, rows.agg(*_checks(schema)).first())
        kinds = _fits[key]
    return Schema(schema.names, kinds, schema.sample, schema.warnings)


def _lines(spark: SparkSession, paths: list[str], options: ReadOptions) -> DataFrame:
    """(line): all data lines; the CSV reader, told of no separator that occurs, drops each file's header."""
    if options.header:
        return spark.read.schema("line string").csv(paths, sep="\0", quote="", escape="", header=True, enforceSchema=True, maxCharsPerColumn=-1, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return spark.read.text(paths).withColumnRenamed("value", "line")


def _typed(value: Column, kind: str) -> Column:
    if kind == "text":
        return value
    if kind == "int":
        return value.try_cast("bigint")  # only digits with a sign, blanks around them, within 64 bits
    pattern = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
    return F.when(value.rlike(pattern), F.trim(value).try_cast("double"))


def _by_lines(spark: SparkSession, paths: list[str], options: ReadOptions, schema: Schema) -> DataFrame:
    return split_lines(_lines(spark, paths, options), options, schema)


def split_lines(lines: DataFrame, options: ReadOptions, schema: Schema) -> DataFrame:
    """A frame of one column `line`, each a record, as columns of the schema; batch or streaming."""
    return lines.select(_parts(options, schema).alias("p")).select(*_values(F.col("p"), options, schema))


def _cut(x: Column, options: ReadOptions) -> Column:
    d = options.delimiter
    if d == " " and not options.keep_leading_space:
        return F.split(F.regexp_replace(x, "^ +", ""), " +", -1)
    return F.split(x, "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in d), -1)


def _parts(options: ReadOptions, schema: Schema) -> Column:
    """The fields of `line`, whatever their number."""
    n, line = len(schema.names), F.col("line")
    # only a line longer than a field may be can hold a field that is too long
    large = (F.length(line) > options.max_field) & F.exists(_cut(line, options), lambda x: F.length(x) > options.max_field)
    line = F.when(large, F.raise_error(F.lit(f"TEXTLOOM[{errors.FIELD_SIZE}] Column length is larger than the maximum of {options.max_field}"))).otherwise(line)
    parts = _cut(F.nullif(line, F.lit("")), options)  # a blank line has no fields at all
    if options.mode == "strict":
        found = F.when(line == "", 0).otherwise(F.size(_cut(line, options)))
        parts = F.when(found == n, parts).otherwise(F.raise_error(F.concat(F.lit(f"TEXTLOOM[{errors.COLUMN_COUNT}] Strict mode: expected {n} columns and found "), found.cast("string"), F.lit(" in row: "), line)))
    return parts


def _values(p: Column, options: ReadOptions, schema: Schema) -> list[Column]:
    """The schema's columns from the fields of a line."""
    n, d = len(schema.names), options.delimiter
    clean = (lambda x: x) if options.keep_leading_space or d == " " else F.ltrim
    # what a long row has too much is joined into the last column
    rest = F.array_join(F.transform(F.slice(p, n, F.greatest(F.lit(1), F.size(p) - (n - 1))), clean), d)
    values = [clean(F.get(p, F.lit(i))) for i in range(n - 1)] + [F.when(F.size(p) > n, rest).otherwise(clean(F.get(p, F.lit(n - 1))))]
    return [_typed(v, k).alias(name) for v, k, name in zip(values, schema.kinds, schema.names, strict=True)]


_ARROW = {"int": pa.int64(), "real": pa.float64(), "text": pa.string()}


def to_batches(rows: Iterator[list[str]], options: ReadOptions, schema: Schema, where: str, header: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows in the schema's types; header: whether the rows follow one, if there is any."""
    n, strict = len(schema.names), options.mode == "strict"
    at = int(options.header and header)
    while chunk := list(itertools.islice(rows, BATCH_ROWS)):
        if strict:
            for k, r in enumerate(chunk):
                if len(r) != n:
                    raise EngineError(errors.COLUMN_COUNT, f"Strict mode: expected {n} columns and found {len(r)} in row {at + k + 1} of {where}")
        at += len(chunk)
        columns = zip(*[fitted(r, n, options.delimiter) for r in chunk], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([convert(v, k) for v in c] if k != "text" else c, _ARROW[k]) for c, k in zip(columns, schema.kinds, strict=True)], [f"f{i}" for i in range(n)])


def _by_records(spark: SparkSession, paths: list[str], options: ReadOptions, schema: Schema) -> DataFrame:
    if options.encoding.lower().replace("_", "-") in ("utf-8", "utf8") and (not options.gzipped or all(p.endswith(".gz") for p in paths)):
        return _by_blocks(spark, paths, options, schema)
    return _by_files(spark, paths, options, schema)


def _arrow_ddl(schema: Schema) -> str:
    return ", ".join(f"f{i} {SPARK_TYPES[k]}" for i, k in enumerate(schema.kinds))


def _by_blocks(spark: SparkSession, paths: list[str], options: ReadOptions, schema: Schema) -> DataFrame:
    """Blocks of any file parsed apart, see `blocks`; what lies across blocks is put together after them."""
    from textloom.ship import ship

    ship(spark)
    key = _key(spark, paths, options), options.delimiter, options.keep_leading_space, options.double_quote_escape, options.mode
    if key not in _blocks:
        _blocks[key] = blocks.survey(spark, paths, options)
    found = _blocks[key]
    sent = spark.sparkContext.broadcast(found)  # a few bytes for each block

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, start), parts in blocks.runs(batches):
            k = sent.value.find(path, start)
            rows = blocks.records(blocks.decoded(parts, options, path), sent.value.states[path][k], options, path)
            if options.header and not k:
                next(rows, None)
            yield from to_batches(rows, options, schema, path if not k else f"{path} from byte {start}", header=not k)

    lines = blocks.lines(spark, paths)
    made = lines.mapInArrow(parse, _arrow_ddl(schema))
    if found.any_open():

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (path, start), parts in blocks.runs(batches):
                m = sent.value
                k = m.find(path, start)
                head, tail = int(m.heads[path][k]), int(m.tails[path][k])
                if head < 0 and tail < 0:
                    continue
                lead, rest = blocks.pieces(blocks.decoded(parts, options, path), m.states[path][k], options)
                some = [(c, t) for c, t in ((head, lead), (tail, rest)) if c >= 0 and t is not None]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array([c for c, _ in some], pa.int64()), pa.array([k] * len(some), pa.int64()), pa.array([t for _, t in some], pa.string())], ["path", "chain", "at", "text"])

        def join(pieces: pa.Table) -> pa.Table:
            path, chain = pieces["path"][0].as_py(), pieces["chain"][0].as_py()
            text = "\n".join(t for _, t in sorted(zip(pieces["at"].to_pylist(), pieces["text"].to_pylist(), strict=True)))
            rows = records(io.StringIO(text, newline=None), options, path)
            if options.header and not chain and path in sent.value.long_first:
                next(rows, None)
            return pa.Table.from_batches(list(to_batches(rows, options, schema, path)), pa.schema([(f"f{i}", _ARROW[k]) for i, k in enumerate(schema.kinds)]))

        cuts = lines.mapInArrow(cut, "path string, chain long, at long, text string")
        made = made.union(cuts.groupBy("path", "chain").applyInArrow(join, _arrow_ddl(schema)))
    return made.toDF(*schema.names)


def _by_files(spark: SparkSession, paths: list[str], options: ReadOptions, schema: Schema) -> DataFrame:
    """Text in other encodings than UTF-8: each file is one value, of 2 GiB at most, and one record stream."""
    from textloom.ship import ship

    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = records(opened(content.as_py(), options, files.is_gzip(path, options.gzipped)), options, path)
                if options.header:
                    next(rows, None)
                yield from to_batches(rows, options, schema, path)

    content = spark.read.format("binaryFile").load(paths).select("path", "content")
    return content.mapInArrow(run, _arrow_ddl(schema)).toDF(*schema.names)


def _widest(kinds: list[str]) -> str:
    return "text" if "text" in kinds else "real" if "real" in kinds else "int"


def full_inference(spark: SparkSession, paths: list[str], options: ReadOptions, schema: Schema) -> Schema:
    """Types over all rows: what doesn't fit the sampled type makes its column text, so nothing is lost."""
    names, text = schema.names, Schema(schema.names, ["text"] * len(schema.names))
    rows = read(spark, paths, options, text).toDF(*[f"f{i}" for i in range(len(names))])
    checks = []
    for i in range(len(names)):
        v = F.col(f"f{i}")
        filled = v.isNotNull() & (v != "")
        checks += [F.coalesce(F.bool_and(F.when(filled, _typed(v, k).isNotNull())), F.lit(False)).alias(f"{k}{i}") for k in ("int", "real")]
    got = rows.agg(*checks).first()
    kinds = ["int" if got[f"int{i}"] else "real" if got[f"real{i}"] else "text" for i in range(len(names))]
    return Schema(names, kinds, schema.sample, schema.warnings)


def schema_of(spark: SparkSession, paths: list[str], options: ReadOptions, whole: bool = True) -> Schema:
    """Names and types: from the first rows, and widened where later rows need it unless only a sample is asked for."""
    header, rows = sample(spark, paths, options)
    found = infer(rows, header, options)
    if options.as_text or not rows or not whole:
        return found
    if options.full_scan_inference:
        return full_inference(spark, paths, options, found)
    return fits(spark, paths, options, found) if len(rows) >= options.sample_rows else found


def read(spark: SparkSession, paths: list[str], options: ReadOptions, schema: Schema) -> DataFrame:
    """The files as one table of the schema."""
    if is_plain(spark, paths, options):
        return _by_lines(spark, paths, options, schema)
    return _by_records(spark, paths, options, schema)


def _shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    to = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not to and sc.master.split("[")[0] != "local":
        raise EngineError(errors.SQL, "A stream of this size needs spark.checkpoint.dir, a folder that the driver and all executors share")
    return f"{to or tempfile.mkdtemp(prefix='textloom-')}/stream-{uuid.uuid4().hex}"


def from_stream(spark: SparkSession, stream, options: ReadOptions) -> tuple[DataFrame, Schema]:  # noqa: ANN001
    """A bounded stream, such as standard input, read to its end through the driver it comes in by.

    The driver holds STREAM_ROWS rows at a time: a longer stream goes, as text,
    to a table in the shared folder as it comes in. Types are those that all
    its rows fit.
    """
    first_bytes = stream.read(1 << 16)
    if isinstance(first_bytes, bytes):
        if first_bytes[:2] == b"\x1f\x8b" or options.gzipped:
            raise EngineError(errors.GZ_STDIN, "Cannot decompress standard input; pipe it through zcat")
        text: io.TextIOBase = io.TextIOWrapper(io.BufferedReader(_Joined(first_bytes, stream)), encoding=options.encoding, newline=None)
    else:
        text = io.StringIO(first_bytes + stream.read(), newline=None)
    if options.gzipped:
        raise EngineError(errors.GZ_STDIN, "Cannot decompress standard input; pipe it through zcat")
    rows = records(text, options, "stream")
    header = None
    if options.header and (header := next(rows, None)) is None:
        raise EngineError(errors.HEADER_MISSING, "Header line is expected but missing in the stream")
    first = list(itertools.islice(rows, options.sample_rows))
    schema = infer(first, header, options)
    n = len(schema.names)
    plain = Schema([f"f{i}" for i in range(n)], ["text"] * n)
    batches = to_batches(itertools.chain(first, rows), options, plain, "stream")
    none = pa.schema([(f"f{i}", pa.string()) for i in range(n)])
    held, frame, folder = [], None, None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        full = sum(b.num_rows for b in held) >= STREAM_ROWS
        if folder is None and batch is None:
            frame = spark.createDataFrame(pa.Table.from_batches(held, none))
        elif full or (batch is None and held):
            folder = folder or _shared_folder(spark)
            spark.createDataFrame(pa.Table.from_batches(held, none)).write.mode("append").parquet(folder)
            held = []
    if frame is None:
        frame = spark.read.schema(", ".join(f"f{i} string" for i in range(n))).parquet(folder)
    if not options.as_text and any(k != "text" for k in schema.kinds):
        schema = Schema(schema.names, _fitting(schema, frame.agg(*_checks(schema)).first()), schema.sample, schema.warnings)
    return frame.select(*[_typed(F.col(f"f{i}"), k).alias(name) for i, (k, name) in enumerate(zip(schema.kinds, schema.names, strict=True))]), schema


class _Joined(io.RawIOBase):
    """Bytes already taken from a stream, then the rest of it."""

    def __init__(self, first: bytes, rest) -> None:  # noqa: ANN001
        self.first, self.rest = first, rest

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:  # noqa: ANN001
        data = self.first[: len(into)] or self.rest.read(len(into))
        self.first = self.first[len(into) :]
        into[: len(data)] = data
        return len(data)
