"""Quoted text in splits: which record the start of each block of a file lies in, found without reading from the start.

Spark cuts files into blocks of whole lines. A quoted newline may straddle any
cut, so a block may start between records (S), inside a quoted field (Q), or in
a field that goes on after an escaped line end (F).

1. Each block is read once under all three assumptions, each giving the state
   at its end; lines without quotes and backslashes change none and are skipped.
2. The driver follows these from block to block of a file: a few bytes a block,
   whatever the text. Then the start of every block is known.
3. Blocks are parsed, each by itself: what it starts inside of belongs to the
   block where that record began, and is skipped, as is the record that a block
   leaves open at its end.
4. Such records, if there are any, are put together from the pieces that the
   blocks hold of them, by a shuffle of those pieces alone.

Blocks must be cut alike whenever they are read, so the figure that Spark
derives from the number of cores is fixed in the session.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import errors
from textloom.errors import EngineError
from textloom.options import ReadOptions

#: What comes before a block's first line to put a reader into each state.
PREFIX = {"S": "", "Q": '"', "F": "x"}
STATES = "SQF"


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, start, line as binary): the lines of each block in their order."""
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[pa.Array]]]:
    """Blocks one after the other: their names, and their lines in arrays."""
    state: dict = {"batch": None, "at": 0}

    def more() -> bool:
        while state["batch"] is None or state["at"] >= state["batch"].num_rows:
            state["batch"], state["at"] = next(batches, None), 0
            if state["batch"] is None:
                return False
        return True

    def name() -> tuple[str, int]:
        return state["batch"].column(0)[state["at"]].as_py(), state["batch"].column(1)[state["at"]].as_py()

    def parts(own: tuple[str, int]) -> Iterator[pa.Array]:
        while more() and name() == own:
            b, at = state["batch"], state["at"]
            same = pc.and_(pc.equal(b.column(0), own[0]), pc.equal(b.column(1), own[1])).to_numpy(zero_copy_only=False)[at:]
            n = int(np.argmin(same)) if not same.all() else len(same)
            state["at"] += n
            yield b.column(2).slice(at, n)

    while more():
        own = name()
        inside = parts(own)
        yield own, inside
        for _ in inside:  # what the caller left
            pass


def decoded(parts: Iterable[pa.Array], options: ReadOptions, name: str) -> Iterator[str]:
    for part in parts:
        try:
            text = b"\n".join(part.to_pylist()).decode(options.encoding)
        except UnicodeError as e:
            raise EngineError(errors.DECODE, f"Cannot decode {name} as {options.encoding}: {e}") from None
        if len(part):
            yield from text.split("\n")


def _telling(parts: Iterable[pa.Array], options: ReadOptions, name: str) -> list[str]:
    """The lines of a block that may change its state: the first, those with a quote or backslash, and each one's next."""
    out: list[str] = []
    after = True
    for part in parts:
        if not len(part):
            continue
        odd = pc.or_(pc.match_substring(part, '"'), pc.match_substring(part, "\\")).to_numpy(zero_copy_only=False)
        keep = odd.copy()
        keep[1:] |= odd[:-1]
        keep[0] |= after
        after = bool(odd[-1])
        out += decoded([part.filter(pa.array(keep))], options, name)
    return out


def passage(text: list[str], state: str, options: ReadOptions) -> tuple[str, bool]:
    """The state after the lines if they start in `state`, and whether any record ends in them."""
    now = {"fresh": True, "end": "S", "closed": state == "S" and not text}

    def feed() -> Iterator[str]:
        for k, line in enumerate(text):
            now["fresh"] = False
            yield (PREFIX[state] if not k else "") + line + "\n"
        if now["fresh"]:
            return
        # a separator ends nothing inside quotes, but lets an unquoted record end with its line
        now["end"] = "F"
        yield options.delimiter + "\n"
        if not now["fresh"]:
            now["end"] = "Q"

    try:
        for _ in csv.reader(feed(), **options.dialect()):
            now["closed"] |= now["end"] == "S"
            now["fresh"] = True
    except csv.Error:
        return "S", True  # only a wrong assumption, or a fault that parsing will name
    return now["end"], now["closed"]


@dataclass
class Map:
    """For each file: its blocks' first bytes, the state at each one's start, and the chains that its open records belong to (-1: none)."""

    starts: dict[str, np.ndarray]
    states: dict[str, str]
    heads: dict[str, np.ndarray]
    tails: dict[str, np.ndarray]
    #: Files whose first record doesn't end in their first block.
    long_first: set[str]

    def find(self, path: str, start: int) -> int:
        own = self.starts.get(path)
        k = int(np.searchsorted(own, start)) if own is not None else 0
        if own is None or k == len(own) or own[k] != start:
            raise EngineError(errors.SQL, f"The blocks of {path} have changed since it was loaded; load it again")
        return k

    def any_open(self) -> bool:
        return any((x >= 0).any() for x in self.tails.values())


def survey(spark: SparkSession, paths: list[str], options: ReadOptions) -> Map:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 62)
        for (path, start), parts in runs(batches):
            text = _telling(parts, options, path)
            found = [passage(text, s, options) for s in STATES]
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array(["".join(e for e, _ in found)]), pa.array(["".join("1" if c else "0" for _, c in found)])], ["path", "start", "ends", "closed"])

    per_file: dict[str, list[tuple]] = {}
    for r in lines(spark, paths).mapInArrow(run, "path string, start long, ends string, closed string").collect():  # a row a block
        per_file.setdefault(r["path"], []).append((r["start"], r["ends"], r["closed"]))
    out = Map({}, {}, {}, {}, set())
    for path, blocks in per_file.items():
        if min(blocks)[2][0] == "0":
            out.long_first.add(path)
        state, chain, states, heads, tails = "S", -1, "", [], []
        for k, (_, ends, closed) in enumerate(sorted(blocks)):
            s = STATES.index(state)
            states += state
            heads.append(chain)
            if state != "S" and closed[s] == "0":
                tails.append(-1)  # the whole block lies inside one record
            else:
                tails.append(k if ends[s] != "S" else -1)
                chain = tails[-1]
            state = ends[s]
        out.starts[path] = np.array(sorted(b[0] for b in blocks), np.int64)
        out.states[path] = states
        out.heads[path], out.tails[path] = np.array(heads, np.int64), np.array(tails, np.int64)
    return out


def records(text: Iterator[str], state: str, options: ReadOptions, name: str) -> Iterator[list[str]]:
    """The records that begin and end in a block's lines."""
    now = {"fresh": True, "open": False}

    def feed() -> Iterator[str]:
        first = True
        for line in text:
            now["fresh"] = False
            yield (PREFIX[state] if first else "") + line + "\n"
            first = False
        now["open"] = not now["fresh"]

    skip = state != "S"
    csv.field_size_limit(options.max_field)
    reader = csv.reader(feed(), **options.dialect())
    try:
        for row in reader:
            if now["open"]:
                return
            now["fresh"] = True
            if skip:
                skip = False
                continue
            yield row
    except csv.Error as e:
        raise fault(e, options, f"{name}:{reader.line_num}") from None


def fault(e: csv.Error, options: ReadOptions, where: str) -> EngineError:
    if "field larger" in str(e):
        return EngineError(errors.FIELD_SIZE, f"Column length is larger than the maximum of {options.max_field}, at {where}")
    return EngineError(errors.DECODE, f"Cannot parse {where}: {e}")


def pieces(text: Iterator[str], state: str, options: ReadOptions) -> tuple[str | None, str | None]:
    """What a block holds of the record it starts inside of, and of the one it leaves open; both are the same if it is all one record."""
    now = {"fresh": True}
    held: list[str] = []
    lead: str | None = None

    def feed() -> Iterator[str]:
        first = True
        for line in text:
            if now["fresh"]:
                held.clear()
            now["fresh"] = False
            held.append(line)
            yield (PREFIX[state] if first else "") + line + "\n"
            first = False
        now["end"] = True

    skip = state != "S"
    csv.field_size_limit(1 << 62)
    for _ in csv.reader(feed(), **options.dialect()):
        if now.get("end"):
            break
        now["fresh"] = True
        if skip:
            lead, skip = "\n".join(held), False
    tail = None if now["fresh"] else "\n".join(held)
    return (tail if skip else lead), (None if skip else tail)
