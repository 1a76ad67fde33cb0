"""Best-fit packing of token sequences by bin completion.

Documents become pieces of at most `capacity` tokens. How many sequences are
needed depends only on how often each length occurs, so the pieces' lengths
are counted (at most `capacity` numbers, however large the table) and the
driver packs that histogram: the largest remaining length opens a sequence and
one of its undominated fillings completes it, as many times over as the counts
allow. Incumbents are best-fit solutions: best-fit decreasing, and dives that
fill each sequence best by a convex value of the lengths (POWERS), which spares
short parts for the end. Depth-first branch and bound then goes through all
undominated fillings of each node (`fillings` makes them one by one, least
waste first) while the waste so far leaves room to beat the incumbent. The plan
is a list of patterns with multiplicities; each piece then finds its place from
its rank among the pieces of its length, without any shuffle of texts or tokens.

Defined cases: a null or empty text is its end token alone; repeated rows are
packed like any others; equal counts of lengths give equal plans; the search
ends when a lower bound is met, when all fillings have been tried, or after
`nodes` patterns or STEPS parts, the same at every size; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, ship, slices, two

PART_BYTES = 4 << 20
#: Patterns that the branch and bound applies, and parts that it tries for them, before the incumbent is taken.
NODES, STEPS = 2_000, 500_000
#: A part of a dive's filling is worth its length to such a power.
POWERS = (1.1, 1.5)
#: The JSON file's added tokens, which `tokenizers` finds in plain text even without add_special_tokens; the ranks file has none.
ADDED = {"<|endoftext|>": 50256}


def least_bins(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's L2 over all thresholds, which includes the total over the capacity."""
    best = -(-int(lengths @ counts) // capacity)
    for k in range(0, capacity // 2 + 1):
        big = lengths > capacity - k
        mid = (lengths <= capacity - k) & (lengths > capacity // 2)
        small = (lengths <= capacity // 2) & (lengths >= k)
        room = int(counts[mid].sum()) * capacity - int(lengths[mid] @ counts[mid])
        over = int(lengths[small] @ counts[small]) - room
        best = max(best, int(counts[big].sum() + counts[mid].sum()) + max(0, -(-over // capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit over classes of equal sequences: (pattern, how often)."""
    by_room: list[list[list]] = [[] for _ in range(capacity + 1)]
    for length, count in sorted(zip(lengths.tolist(), counts.tolist(), strict=True), reverse=True):
        room = length
        while count:
            while room <= capacity and not by_room[room]:
                room += 1
            if room > capacity:
                fit = capacity // length
                if count >= fit:
                    by_room[capacity - fit * length].append([(length,) * fit, count // fit])
                    count %= fit
                if count:
                    by_room[capacity - count * length].append([(length,) * count, 1])
                break
            pattern, many = by_room[room].pop()
            took = min(many, count)
            if took < many:
                by_room[room].append([pattern, many - took])
            by_room[room - length].append([(*pattern, length), took])
            count -= took
    return [(p, m) for held in by_room for p, m in held]


def _reach(room: int, counts: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Lengths in stock up to `room`, how many of each may be used, and for each how many first ones the sums they reach, as bits of one integer."""
    lengths = np.flatnonzero(counts[: room + 1]).tolist()
    most = [min(int(counts[x]), room // x) for x in lengths]
    mask, reach = (1 << (room + 1)) - 1, [1]
    for length, left in zip(lengths, most, strict=True):
        sums, step = reach[-1], 1
        while left:
            took = min(step, left)
            sums |= (sums << (took * length)) & mask
            left, step = left - took, 2 * step
        reach.append(sums)
    return lengths, most, reach


class Steps:
    """How many more parts the search may try."""

    def __init__(self, left: int) -> None:
        self.left = left

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


def _spread(bits: int, width: int) -> int:
    """bits, and each of them at the next `width` places too."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        bits |= bits << step
        done += step
    return bits


def fillings(room: int, counts: np.ndarray, waste: int | None = None, steps: Steps | None = None) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of `room` from the stock, one by one: least waste first, then long parts before short ones.

    waste: none that waste more. A filling is dominated if another one has parts
    that take its parts up; then it has such a single step to one at least as
    good: a spare length beside its parts, or in place of one or more of them.
    As parts are chosen from long to short, a spare length that can replace
    some of them stays spare, so a dominated beginning is given up at once.
    """
    lengths, most, reach = _reach(room, counts)
    steps = steps or Steps(1 << 62)
    stock = sum(1 << x for x in lengths)
    # lengths of which no filling can use up all
    always = sum(1 << x for x, n in zip(lengths, most, strict=True) if counts[x] > room // x)
    sums = reach[-1]
    while sums:
        goal = sums.bit_length() - 1
        sums ^= 1 << goal
        left = room - goal
        low = (1 << (left + 1)) - 1
        if (waste is not None and left > waste) or always & low:
            return  # there is room beside these, and beside all fillings that waste more

        def exact(goal: int, k: int, spare: int, some: int, many: int, singles: int, left: int = left, low: int = low) -> Iterator[tuple[int, ...]]:
            # some, many, singles: sums of one part or more, of two or more, and the parts themselves, as bits
            if not goal:
                if not spare & low & ~1:
                    yield ()
                return
            for i in range(k - 1, -1, -1):
                if not reach[i + 1] >> goal & 1:
                    return
                length = lengths[i]
                s, m, one, parts = some, many, singles | 1 << length, 0
                for parts in range(1, min(most[i], goal // length) + 1):
                    if not steps.take():
                        return
                    s, m = s | s << length | 1 << length, m | s << length
                    now = spare & ~(1 << length) if parts == counts[length] else spare
                    if now & (_spread(m, left) | (_spread(one << 1, left - 1) if left else 0)):
                        break
                    if reach[i] >> (goal - parts * length) & 1:
                        for rest in exact(goal - parts * length, i, now, s, m, one):
                            yield (length,) * parts + rest

        yield from exact(goal, len(lengths), stock, 0, 0, 0)


def worthiest(room: int, counts: np.ndarray, worth: np.ndarray) -> tuple[int, ...]:
    """The filling of `room` whose parts are worth most."""
    best, takes = np.zeros(room + 1), []
    for length in np.flatnonzero(counts[: room + 1]).tolist():
        left, step = min(int(counts[length]), room // length), 1
        while left:
            took = min(step, left)
            size = took * length
            more = best[: room + 1 - size] + took * worth[length]
            better = more > best[size:]
            if better.any():
                best[size:] = np.where(better, more, best[size:])
                takes.append((length, took, better))
            left, step = left - took, 2 * step
    at, parts = room, []
    for length, took, better in reversed(takes):
        size = took * length
        if at >= size and better[at - size]:
            parts += [length] * took
            at -= size
    return tuple(sorted(parts, reverse=True))


def _apply(stock: np.ndarray, pattern: tuple[int, ...], times: int | None = None) -> int:
    """Take the pattern's parts out of the stock, as often as there are or `times`; how often that was."""
    parts, need = np.unique(np.array(pattern), return_counts=True)
    many = int((stock[parts] // need).min()) if times is None else times
    stock[parts] -= need * many
    return many


def dive(stock: np.ndarray, capacity: int, power: float, most: int) -> list[tuple[tuple[int, ...], int]] | None:
    """Sequences filled one after the other, around the largest length left, by a convex value of lengths; None if that takes `most` or more."""
    stock, worth = stock.copy(), np.arange(capacity + 1.0) ** power
    plan, used = [], 0
    room_left = (most - 1) * capacity - int(stock @ np.arange(capacity + 1))
    while stock.any():
        top = int(np.flatnonzero(stock)[-1])
        stock[top] -= 1
        pattern = (top, *worthiest(capacity - top, stock, worth))
        stock[top] += 1
        times = _apply(stock, pattern)
        room_left -= times * (capacity - sum(pattern))
        if room_left < 0:
            return None
        plan.append((pattern, times))
        used += times
    return plan if used < most else None


def _choices(stock: np.ndarray, capacity: int, room_left: int, steps: Steps) -> Iterator[tuple[tuple[int, ...], int | None]]:
    """Patterns around the largest length and how often to apply them: first as often as can be, then once, within the waste that is left."""
    top = int(np.flatnonzero(stock)[-1])
    rest = stock.copy()
    rest[top] -= 1
    several = False
    for times in (None, 1):
        if times and not several:
            return
        for parts in fillings(capacity - top, rest, room_left, steps):
            need = {x: (top, *parts).count(x) for x in (top, *parts)}
            several |= (often := min(int(stock[x]) // n for x, n in need.items())) > 1
            if times is None or often > 1:
                yield (top, *parts), times


def pack_histogram(lengths: list[int], counts: list[int], capacity: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and multiplicities that use every piece once, in as few sequences as the search finds."""
    if not lengths:
        return []
    n_l, n_c = np.array(lengths, np.int64), np.array(counts, np.int64)
    best = best_fit_decreasing(n_l, n_c, capacity)
    bound, most = least_bins(n_l, n_c, capacity), sum(m for _, m in best)
    stock = np.zeros(capacity + 1, np.int64)
    stock[n_l] = n_c
    for power in POWERS:
        if most == bound:
            return best
        if (found := dive(stock, capacity, power, most)) is not None:
            best, most = found, sum(m for _, m in found)
    total, steps = int(n_l @ n_c), Steps(STEPS)
    # a level: the stock there, the choices left to try, what was used and wasted before, how long the plan was
    levels: list[tuple] = [(stock, _choices(stock, capacity, (most - 1) * capacity - total, steps), 0, 0, 0)]
    plan: list[tuple[tuple[int, ...], int]] = []
    for _ in range(nodes):
        # the deepest level's next choice that the waste bound allows
        while levels:
            held, choices, used, waste, depth = levels[-1]
            taken = next(choices, None) if most > bound else None
            if taken is not None:
                break
            levels.pop()
        if not levels:
            break
        now = held.copy()
        times = _apply(now, *taken)
        waste += times * (capacity - sum(taken[0]))
        if waste > (most - 1) * capacity - total:
            continue
        plan = [*plan[:depth], (taken[0], times)]
        if now.any():
            levels.append((now, _choices(now, capacity, (most - 1) * capacity - total - waste, steps), used + times, waste, depth + 1))
        elif used + times < most:
            best, most = list(plan), used + times
    return best


def placements(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length and run of ranks: where the run starts, its first sequence, parts a sequence, first offset.

    Rows are sorted by length, then by rank; there are as many as distinct
    lengths in all patterns, whatever the number of pieces.
    """
    rows, taken, sequence = [], {}, 0
    for pattern, times in plan:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            each = pattern.count(length)
            start = taken.get(length, 0)
            rows.append((length, start, sequence, each, at))
            taken[length] = start + each * times
            at += each * length
        sequence += times
    found = np.array(sorted(rows) or np.empty((0, 5)), np.int64).reshape(-1, 5)
    return dict(zip(("length", "start", "sequence", "each", "offset"), found.T, strict=True))


_TOKENIZERS: dict[tuple[str, str], object] = {}


def _tiktoken(path: str, pattern: str):  # noqa: ANN202
    import tiktoken

    if (path, pattern) not in _TOKENIZERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _TOKENIZERS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=ADDED)
    return _TOKENIZERS[path, pattern]


def _encoder(path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """A text's ids. Runs of blanks that overflow tiktoken's regex stack go through the JSON file itself."""
    fast = _tiktoken(path, pattern).encode_to_numpy

    def encode(text: str) -> np.ndarray:
        try:
            return fast(text, allowed_special="all")
        except ValueError:
            import tokenizers

            if (path, "json") not in _TOKENIZERS:
                _TOKENIZERS[path, "json"] = tokenizers.Tokenizer.from_file(f"{path.removesuffix('.tiktoken')}.json")
            return np.array(_TOKENIZERS[path, "json"].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def pieces(docs: DataFrame, path: str, pattern: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row of docs.

    The ranks file at `path` gives the same ids as the JSON file of the same
    vocabulary does in `tokenizers`, at three times the speed (tests compare
    them over code points and texts with added tokens). Only the first piece of
    a document may be shorter than `capacity`.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern)
        for part in slices(batches, PART_BYTES):
            out: list[tuple] = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), end_id).astype("<u4")
                raw, n = memoryview(ids.tobytes()), len(ids)
                start, stop = 0, (n - 1) % capacity + 1
                for k in range(-(-n // capacity)):
                    out.append((doc_id, k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                    start, stop = stop, stop + capacity
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return two(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(found: DataFrame, capacity: int, nodes: int = NODES) -> DataFrame:
    """The rows of `found` (from pieces(), or any with a length up to `capacity`) with sequence_id and offset.

    The pieces are cut first: ranks are given partition by partition, so these
    must stay as they are if an executor is lost between the two passes. A
    partition goes by the number written beside its rows.
    """
    spark = found.sparkSession
    names = found.columns
    held = cut(found.withColumn("__part", F.spark_partition_id()))
    per = held.groupBy("__part", "length").count()
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = per.select("__part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    histogram = per.groupBy("length").agg(F.sum("count").alias("n")).orderBy("length").collect()
    plan = pack_histogram([r["length"] for r in histogram], [r["n"] for r in histogram], capacity, nodes)
    places = spark.sparkContext.broadcast(placements(plan))
    schema = found.schema

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy().astype(np.int64)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else ordered
            local = np.empty(len(length), np.int64)
            local[order] = np.arange(len(ordered)) - np.repeat(edge, np.diff(np.append(edge, len(ordered))))
            local += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], [*b.schema.names, "__rank"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = places.value
        key = p["length"] << 44 | p["start"]
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy().astype(np.int64)
            rank = b.column(b.schema.get_field_index("__rank")).to_numpy() + b.column(b.schema.get_field_index("__first")).to_numpy()
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            n = rank - p["start"][at]
            sequence, offset = p["sequence"][at] + n // p["each"][at], p["offset"][at] + n % p["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    ranked = held.mapInArrow(rank, T.StructType([*held.schema.fields, T.StructField("__rank", T.LongType())]))
    joined = ranked.join(first, ["__part", "length"]).select(*names, "__rank", "__first")
    return joined.mapInArrow(place, T.StructType([*schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
