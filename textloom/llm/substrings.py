"""Substring dedup by seed and extend over winnowed anchors.

A window is `length` consecutive words of a text. Its anchor is the least hash
among its runs of `seed` words, so equal windows have equal anchors wherever
they lie, and neighbouring windows mostly share one (winnowing).

1. Seeds: each text's distinct anchors; those of one text only can't lie in a
   passage that two texts share. Anchors that repeat inside a text are seeds too.
2. Join: anchors are counted with map-side sums, the repeated ones joined back
   to their texts, and only these texts go on.
3. Extend: from each repeated anchor both ways over every window that has it,
   identified by its anchor and a 64-bit hash of its words. A text sends each
   window once, and the least doc_id of each window is kept as its owner, again
   with map-side minima: a passage that a third of all texts have costs a row
   for each task, not for each pair.
4. A window is a repeat unless its text owns it and it starts there first;
   neighbouring repeats make maximal repeats, whose words are removed.

Windows are judged on the input. Nothing is capped; wrong removals need equal
96-bit hashes of different windows.

Defined cases: null or empty texts have no words; rows that share an id count
as one document seen twice, of which neither is earlier, but each row loses
words of its own text only; rows without an id are documents of their own,
before all others, in the order of row numbers that are written once (another
partitioning gives another order); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop, free_name, release, ship, slices, table, text_bytes
from textloom.llm.words import Words

LENGTH, SEED = 20, 8
PART_BYTES = 4 << 20
#: What a row is known by: its id, its number if it has no id, and a hash of its text if others share the id.
KEY = ["doc_id", "row", "mark"]
_KEYS = "doc_id long, row long, mark long"


def sliding_min(h: np.ndarray, n: int) -> np.ndarray:
    """Entry i: the least of h[i : i + n], by doubling; the last n - 1 entries mean nothing."""
    out, width = h, 1
    while width < n:
        step = min(width, n - width)
        more = out.copy()
        np.minimum(out[:-step], out[step:], out=more[:-step])
        out, width = more, width + step
    return out


class Windows:
    """Anchors and hashes of all windows of a batch of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> None:
        self.words = Words(data, offsets, lower=False)
        self.length = length
        h = self.words.grams(seed) if len(self.words.hashes) else self.words.hashes
        self.anchors = sliding_min(h, length - seed + 1) if len(h) else h
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = self.words.grams(self.length)
        return self._hashes

    def spans(self) -> list[tuple[int, int]]:
        """For each text, the run of its windows by their first words."""
        return [(a, max(a, a + n - self.length + 1)) for a, n in zip(self.words.first.tolist(), self.words.counts.tolist(), strict=False)]


def joined(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])


def numbered(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a column of row numbers, and its name: -1 for rows with an id, else a number that no other row has.

    Only the rows without an id are written, so that their numbers stay.
    """
    row, none = free_name(docs.columns, "__row"), docs[id_col].cast("long").isNull()
    held = table(docs.where(none).withColumn(row, F.monotonically_increasing_id()), "no-id")
    return docs.where(~none).withColumn(row, F.lit(-1).cast("long")).unionByName(held), row


def key_of(docs: DataFrame, row: str, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """KEY of the rows of docs; doc_id is 0 where there is none."""
    return [F.coalesce(docs[id_col].cast("long"), F.lit(0)).alias("doc_id"), docs[row].alias("row"), F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("mark")]


def _seeds(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """KEY, n_words, whole_sha256 (its words joined by spaces), anchors (distinct), again (anchors of windows it has twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES):
            data, offsets = text_bytes(part.column(3))
            w = Windows(data, offsets, length, seed)
            raw, edges = data.tobytes(), offsets.tolist()
            anchors, again = [], []
            for a, z in w.spans():
                own = np.sort(w.anchors[a:z])
                anchors.append(own[np.append(True, own[1:] != own[:-1])].astype(np.int64) if z > a else np.empty(0, np.int64))
                if z > a + 1:
                    order = np.argsort(w.hashes[a:z], kind="stable")
                    h = w.hashes[a:z][order]
                    again.append(np.unique(w.anchors[a:z][order[1:]][h[1:] == h[:-1]]).astype(np.int64))
                else:
                    again.append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[:3],
                    pa.array(w.words.counts, pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(edges, edges[1:], strict=False)]),
                    pa.array(anchors, pa.list_(pa.int64())),
                    pa.array(again, pa.list_(pa.int64())),
                ],
                [*KEY, "n_words", "whole_sha256", "anchors", "again"],
            )

    return docs.mapInArrow(run, f"{_KEYS}, n_words long, whole_sha256 string, anchors array<long>, again array<long>")


def _extended(suspects: DataFrame, length: int, seed: int) -> DataFrame:
    """(tag, hash, doc_id, row): each text's distinct windows about its repeated anchors; tag is 32 bits of the anchor.

    Either doc_id or row is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES):
            w = Windows(*text_bytes(part.column(3)), length, seed)
            tags, hashes, many = [np.empty(0, np.int32)], [np.empty(0, np.int64)], np.zeros(part.num_rows, np.int64)
            for i, ((a, z), seeds) in enumerate(zip(w.spans(), part.column(4).to_numpy(zero_copy_only=False), strict=True)):
                own = w.anchors[a:z].astype(np.int64)
                some = np.flatnonzero(np.isin(own, seeds))
                if len(some):
                    _, at = np.unique(w.hashes[a:z][some], return_index=True)
                    some = some[at]
                    tags.append((own[some] >> 32).astype(np.int32))
                    hashes.append(w.hashes[a:z][some].astype(np.int64))
                    many[i] = len(some)
            ids, rows = (np.repeat(part.column(k).to_numpy(), many) for k in (0, 1))
            named = rows < 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tags)), pa.array(np.concatenate(hashes)), pa.array(ids, mask=~named), pa.array(rows, mask=named)], ["tag", "hash", "doc_id", "row"])

    return suspects.mapInArrow(run, "tag int, hash long, doc_id long, row long")


def _removed(part: pa.RecordBatch, length: int, seed: int) -> Iterator[tuple[Words, bytes, int, np.ndarray]]:
    """For each text of (*KEY, text, seeds, owned): words, bytes, its first word, and which of its words go."""
    data, offsets = text_bytes(part.column(3))
    w = Windows(data, offsets, length, seed)
    raw = data.tobytes()
    for (a, z), n, seeds, owned in zip(w.spans(), w.words.counts.tolist(), part.column(4).to_numpy(zero_copy_only=False), part.column(5).to_numpy(zero_copy_only=False), strict=True):
        edge = np.zeros(n + 1, np.int64)
        if z > a:
            h = w.hashes[a:z].astype(np.int64)
            gone = np.isin(w.anchors[a:z].astype(np.int64), seeds)
            _, first = np.unique(h, return_index=True)
            keeps = np.zeros(z - a, bool)
            keeps[first] = True
            gone &= ~(keeps & np.isin(h, owned))
            starts = np.flatnonzero(gone)
            edge[starts] += 1
            edge[starts + length] -= 1
        yield w.words, raw, a, np.cumsum(edge)[:n] > 0


def suspects(docs: DataFrame, row: str, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What each text's words are, and (*KEY, text, seeds, owned) of the texts with repeated anchors; docs and row from numbered()."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(*key_of(docs, row, id_col, text_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    seen = table(_seeds(texts, length, seed), "seeds")
    rows = seen.select("doc_id", "row", F.explode("anchors").alias("anchor"))
    common = table(rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    release(spark)
    both = rows.join(common, "anchor").select("doc_id", "row", "anchor").union(seen.select("doc_id", "row", F.explode("again").alias("anchor")))
    seeds = table(both.groupBy("doc_id", "row").agg(F.collect_set("anchor").alias("seeds")), "doc-seeds")
    drop(common)
    release(spark)
    held = table(texts.join(seeds, ["doc_id", "row"]).select(*KEY, "text", "seeds"), "suspects")
    drop(seeds)
    release(spark)
    owners = _extended(held, length, seed).groupBy("tag", "hash").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id"))
    owners = owners.select(F.when(F.col("row").isNull(), F.col("doc_id")).otherwise(0).alias("doc_id"), F.coalesce("row", F.lit(-1)).alias("row"), "hash")
    owned = table(owners.groupBy("doc_id", "row").agg(F.collect_set("hash").alias("owned")), "owned")
    release(spark)
    return seen, held.join(owned, ["doc_id", "row"], "left").select(*KEY, "text", "seeds", F.coalesce("owned", F.array().cast("array<long>")).alias("owned"))


def removals(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    rows, row = numbered(docs.select(docs[id_col], docs[text_col]), id_col)
    seen, held = suspects(rows, row, length, seed, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES):
            n, sha = [], []
            for words, raw, a, gone in _removed(part, length, seed):
                kept = a + np.flatnonzero(~gone)
                n.append(int(gone.sum()))
                sha.append(hashlib.sha256(joined(raw, words.starts[kept], words.ends[kept])).hexdigest())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n, pa.int64()), pa.array(sha, pa.string())], [*KEY, "n_removed", "kept_sha256"])

    found = table(held.mapInArrow(run, f"{_KEYS}, n_removed long, kept_sha256 string").where("n_removed > 0").dropDuplicates(KEY), "removals")
    out = seen.select(*KEY, "n_words", "whole_sha256").join(found, KEY, "left")
    return out.select(
        F.when(F.col("row") < 0, F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )


def shortened(docs: DataFrame, row: str, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(*KEY, text) of the texts that lose words, the maximal repeats cut out and all else as it was; docs and row from numbered()."""
    _, held = suspects(docs, row, length, seed, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES):
            some, out = [], []
            _, offsets = text_bytes(part.column(3))
            for i, (words, raw, a, gone) in enumerate(_removed(part, length, seed)):
                if not gone.any():
                    continue
                edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                at, kept = int(offsets[i]), []
                for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    kept.append(raw[at : words.starts[a + s]])
                    at = int(words.starts[a + e]) if e < len(gone) else int(words.ends[a + e - 1])
                kept.append(raw[at : offsets[i + 1]])
                some.append(i)
                out.append(b"".join(kept).decode())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(some, pa.int64())) for c in part.columns[:3]), pa.array(out, pa.string())], [*KEY, "text"])

    return held.mapInArrow(run, f"{_KEYS}, text string").dropDuplicates(KEY)


def without_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of the texts that lose words, the maximal repeats cut out and all else as it was."""
    rows, row = numbered(docs.select(docs[id_col], docs[text_col]), id_col)
    found = shortened(rows, row, length, seed, id_col, text_col)
    return found.select(F.when(F.col("row") < 0, F.col("doc_id")).alias("doc_id"), "text")
