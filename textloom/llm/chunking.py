"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes with a window of 32 bytes; a chunk ends
where the hash's top bits are zero, more of them being asked for before the
normal chunk size than after it (normalised chunking), and never under the
least or over the greatest size. As no chunk is shorter than the window, a
boundary depends on bytes of its own chunk only, so an insertion moves
boundaries near it and leaves the others. A fingerprint is the set of chunk
digests, each weighted by its chunk's length; the containment of A in B is the
weight of A's digests that B has too, over all of A's weight.

Everything up to the choice of boundaries works on whole batches in numpy: the
gear hash by doubling, the digests from prefix sums of a polynomial hash.

Defined cases: null texts are empty; an empty fingerprint is contained in any
other with 1 if that is empty too, else 0; rows with one id are ordered by
a hash of their text, a null id comes first; a lone row's next document is itself; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ship, slices, text_bytes, two

LEAST, NORMAL, MOST = 32, 96, 384
STRICT_BITS, LOOSE_BITS = 8, 5
PART_BYTES = 4 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
GEAR = _rng.integers(0, 1 << 32, 256, np.uint32)
LETTER = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(1 << max(12, (n - 1).bit_length()), base & (1 << 64) - 1, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= 1 << 23:
            _powers[base] = held
    return held[:n]


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[data[i]] modulo 2**32, which forgets bytes after 32 steps."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends of all texts one after the other, and how many each text has. No chunk spans two texts."""
    h = gear(data)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
    strict = loose[h[loose] >> np.uint32(32 - STRICT_BITS) == 0]
    loose, strict = (loose + 1).tolist(), (strict + 1).tolist()
    loose.append(1 << 62)
    strict.append(1 << 62)
    ends: list[int] = []
    counts: list[int] = []
    edges = offsets.tolist()
    i = j = 0
    for at, end in zip(edges, edges[1:], strict=False):
        had = len(ends)
        while end - at > LEAST:
            i = bisect_left(strict, at + LEAST, i)
            cut = strict[i]
            if cut > at + NORMAL:
                j = bisect_left(loose, at + NORMAL, j)
                cut = min(loose[j], at + MOST)
            if cut >= end:
                break
            ends.append(cut)
            at = cut
        if at < end:
            ends.append(end)
        counts.append(len(ends) - had)
    return np.array(ends, np.int64), np.array(counts, np.int64)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each stretch of bytes, equal wherever the stretch lies."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(LETTER[data] * powers(BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(BASE_INV, n + 1)[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def chunk_sets(data: np.ndarray, offsets: np.ndarray) -> list[dict[int, int]]:
    """Each text's fingerprint: digest to length."""
    ends, counts = cuts(data, offsets)
    starts = np.append(0, ends)[: len(ends)] if len(ends) else ends
    keys, lens = digests(data, starts, ends).tolist(), (ends - starts).tolist()
    out, at = [], 0
    for n in counts.tolist():
        out.append(dict(zip(keys[at : at + n], lens[at : at + n], strict=True)))
        at += n
    return out


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    if not a:
        return 0.0 if b else 1.0
    whole = sum(a.values())
    return sum([a[k] for k in a.keys() & b.keys()]) / whole


def as_string(chunks: dict[int, int]) -> str:
    """Sorted chunks, each as 16 hex digits of its digest and 4 of its length: equal sets, equal strings."""
    keys = np.array(sorted(chunks), ">u8")
    both = np.empty(len(keys), [("d", ">u8"), ("n", ">u2")])
    both["d"] = keys
    both["n"] = [chunks[k] for k in keys.tolist()]
    return both.tobytes().hex()


def _sets_of(texts: list[bytes]) -> list[dict[int, int]]:
    offsets = np.cumsum([0, *map(len, texts)])
    return chunk_sets(np.frombuffer(b"".join(texts), np.uint8), offsets)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digests array<long>, lengths array<int> of each row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES):
            found = chunk_sets(*text_bytes(part.column(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([np.array(sorted(x), np.uint64).astype(np.int64) for x in found], pa.list_(pa.int64())),
                    pa.array([[x[k] for k in sorted(x)] for x in found], pa.list_(pa.int32())),
                ],
                ["doc_id", "digests", "lengths"],
            )

    return two(docs, id_col, text_col).mapInArrow(run, "doc_id long, digests array<long>, lengths array<int>")


class Edges:
    """Where the buckets of (key, spot) begin; a key that fills several has edges among its spots."""

    def __init__(self, quantiles: list[int]) -> None:
        per: dict[int, int] = {}
        for k in quantiles:
            per[k] = per.get(k, 0) + 1
        self.keys = np.array([k for k in sorted(per) for _ in range(per[k])], np.int64)
        self.spots = {k: np.array([-(1 << 63) + (j << 64) // n for j in range(n)], np.int64) for k, n in per.items()}

    def bucket(self, key: np.ndarray, spot: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, key)
        for k in np.intersect1d(key, self.keys).tolist():
            own = key == k
            at[own] += np.searchsorted(self.spots[k], spot[own], "right")
        return at


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, ahead, key, doc_id, text), each bucket a run in the order of ids, then of texts' hashes, in a partition, sorted.

    A bucket ends with the first row of the next one (ahead = 1; for the last
    bucket: of the first), so each row's successor is in its own partition and
    texts are shuffled once. An id (or none) that many rows share fills as many
    buckets as its share of the rows asks for. Only bucket bounds and first rows'
    ids and hashes meet on the driver: a few numbers for each bucket, whose
    number doesn't follow the rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("spot"), "doc_id", "text")
    edges = Edges([int(x) for x in rows.select("key").stat.approxQuantile("key", [i / buckets for i in range(1, buckets)], 0.2 / buckets)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = edges.bucket(b.column(0).to_numpy(), b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], ["bucket", "key", "spot"])

    placed = rows.select("key", "spot").mapInArrow(place, "bucket int, key long, spot long")
    least = {r["bucket"]: tuple(r["first"]) for r in placed.groupBy("bucket").agg(F.min(F.struct("key", "spot")).alias("first")).collect()}
    used = sorted(least)
    before = {least[b]: used[i - 1] for i, b in enumerate(used)}
    firsts = np.array(sorted({k for k, _ in before}), np.int64)

    @F.pandas_udf("array<int>")
    def homes(key, spot):  # noqa: ANN001, ANN202
        import pandas as pd

        k, s = key.to_numpy(np.int64), spot.to_numpy(np.int64)
        out = [[a] for a in edges.bucket(k, s).tolist()]
        for i in np.flatnonzero(np.isin(k, firsts)).tolist():
            ahead = before.get((int(k[i]), int(s[i])))
            if ahead is not None:
                out[i].append(ahead)
        return pd.Series(out)

    if not used:
        return spark.createDataFrame([], "bucket int, ahead int, key long, doc_id long, text string")
    return (
        rows.select("key", "spot", "doc_id", "text", F.posexplode(homes("key", "spot")).alias("ahead", "bucket"))
        .repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket")
        .sortWithinPartitions("bucket", "ahead", "key", "spot", "text")
        .select("bucket", "ahead", "key", "doc_id", "text")
    )


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points
    replaced by as many, or all, of the next document's first ones.
    """
    spark = docs.sparkSession
    ship(spark)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def done(rows: list[tuple], after: str) -> pa.RecordBatch:
        texts = [x for _, x in rows]
        edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for x, y in zip(texts, [*texts[1:], after], strict=True)]
        raw, new = [x.encode() for x in [*texts, after]], [x.encode() for x in edited]
        own, changed = _sets_of(raw), _sets_of(new)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in rows], pa.int64()),
                pa.array(list(map(len, texts)), pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in new], pa.string()),
                pa.array(list(map(as_string, own[:-1])), pa.string()),
                pa.array(list(map(as_string, changed)), pa.string()),
                pa.array(list(map(containment, own[:-1], changed)), pa.float64()),
                pa.array(list(map(containment, own[:-1], own[1:])), pa.float64()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, ended = 0, None
        for part in slices(batches, PART_BYTES, "text"):
            for bucket, ahead, doc_id, text in zip(*(part.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if bucket == ended:
                    continue  # further rows with the next bucket's least id
                if ahead:
                    if held:
                        yield done(held, text)
                    held, size, ended = [], 0, bucket
                    continue
                if size > PART_BYTES:
                    yield done(held, text)
                    held, size = [], 0
                held.append((doc_id, text))
                size += len(text)

    ordered = in_order(two(docs, id_col, text_col), 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
