"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Where a uniform random permutation would send the rows of each partition is
itself random: the counts from partition to shard follow a multivariate
hypergeometric law. That matrix is drawn by halving the partitions, each half
with a generator of its own, so each task draws its line alone and only the
partitions' row counts meet on the driver. Each partition permutes its rows and
deals them out by its line, the rows are exchanged, and each shard is permuted
again by random keys. Shard sizes are exact, at most one row apart, and every
arrangement is equally likely.

Defined cases: a null text has size 16 and the checksum of an empty one; ids
may repeat or be null, each row is dealt by itself; equal texts are not kept
together (the law is `rows`); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import cut, free_name, ship


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` without replacement are good; numpy's own sampler stops at 10**9."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good else 0
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    lg = math.lgamma

    def log_p(k: int) -> float:
        return -(lg(k + 1) + lg(good - k + 1) + lg(draws - k + 1) + lg(bad - draws + k + 1))

    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    sd = math.sqrt(draws * good / (good + bad) * bad / (good + bad) * max(1, good + bad - draws) / (good + bad - 1))
    a, b = max(low, mode - int(12 * sd) - 12), min(high, mode + int(12 * sd) + 12)
    top = log_p(mode)
    # the ratio of neighbours, so that large arguments lose no digits
    k = np.arange(a, b, dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    p = np.append(0.0, np.cumsum(steps))
    p = np.exp(p - p.max() + 0 * top)
    return a + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), "right"))


def _split(rng: np.random.Generator, left: np.ndarray, draws: int) -> np.ndarray:
    """How many of each shard's places `draws` rows get, all arrangements being equally likely."""
    rest = int(left.sum())
    if rest < 10**9:
        return rng.multivariate_hypergeometric(left, draws, method="marginals")
    out = np.zeros_like(left)
    for j, n in enumerate(left.tolist()):
        if not draws:
            break
        rest -= n
        out[j] = got = hypergeometric(rng, n, rest, draws)
        draws -= got
    return out


def line_of(ends: np.ndarray, shards: np.ndarray, part: int, seed: int) -> np.ndarray:
    """One line of the communication matrix: how many rows partition `part` sends to each shard.

    ends[i] is the number of rows before partition i. The partitions are halved
    until one is left, and each half draws its share of the shards' places by a
    generator of its own, so any task can find its line alone, in
    log(partitions) * shards draws, and all lines add up to the shards' sizes.
    """
    low, high, places = 0, len(ends) - 1, np.asarray(shards, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, 2, low, high]))
        first = _split(rng, places, int(ends[mid] - ends[low]))
        if part < mid:
            high, places = mid, first
        else:
            low, places = mid, places - first
    return places


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """counts[i, j]: how many rows partition i sends to shard j in a uniform random permutation."""
    assert sum(rows) == sum(shards)
    ends = np.cumsum([0, *rows])
    return np.array([line_of(ends, np.array(shards), i, seed) for i in range(len(rows))], np.int64).reshape(len(rows), len(shards))


def shard(rows: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """All columns of rows, with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard)."""
    spark = rows.sparkSession
    ship(spark)
    names = rows.columns
    part_col = free_name(names, "__part")
    # partitions go by the number written beside each row: a task's own number may be another one's
    held = cut(rows.withColumn(part_col, F.spark_partition_id()))
    counted = {r[part_col]: r["count"] for r in held.groupBy(part_col).count().collect()}
    ends = np.cumsum([0, *(counted.get(i, 0) for i in range(max(counted, default=-1) + 1))])
    total = int(ends[-1])
    shards = np.array([total // n_shards + (j < total % n_shards) for j in range(n_shards)], np.int64)
    sent = spark.sparkContext.broadcast(ends)  # a number for each partition
    n_out = max(n_shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = -(-n_out // n_shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = rng = None
        at = 0
        for b in batches:
            if to is None:
                if not b.num_rows:
                    continue
                part = b.column(b.num_columns - 1)[0].as_py()
                rng = np.random.Generator(np.random.PCG64([seed, 1, part]))
                to = rng.permutation(np.repeat(np.arange(n_shards, dtype=np.int32), line_of(sent.value, shards, part, seed)))
            n = b.num_rows
            key = rng.integers(0, (1 << 63) - 1, n, np.int64)
            # random keys fall evenly into equal ranges of keys, so a shard's pieces are about equal without a sample
            piece = (key >> 32) * pieces >> 31
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(to[at : at + n]), pa.array(piece.astype(np.int32)), pa.array(key)], [*names, "__shard", "__piece", "__key"])
            at += n

    fields = held.schema.fields[:-1]
    whole, number_ = T.IntegerType(), T.LongType()
    dealt = held.mapInArrow(deal, T.StructType([*fields, T.StructField("__shard", whole), T.StructField("__piece", whole), T.StructField("__key", number_)]))
    order = cut(dealt.repartition(n_out, "__shard", "__piece").sortWithinPartitions("__shard", "__piece", "__key"))
    # a shard's slots run through its pieces, each of which lies in one partition
    starts, seen = {}, {}
    for s, p, n in sorted(tuple(r) for r in order.groupBy("__shard", "__piece").count().collect()):
        starts[s, p] = seen.get(s, 0)
        seen[s] = seen.get(s, 0) + n
    firsts = spark.sparkContext.broadcast(starts)  # shards * pieces numbers, whatever the rows

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for b in batches:
            to, piece = (b.column(len(names) + k).to_numpy().astype(np.int64) for k in (0, 1))
            group = to * pieces + piece
            edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist() if len(group) else []
            slot = np.empty(len(to), np.int64)
            for a, z in zip(edges, [*edges[1:], len(to)], strict=True):
                if group[a] != now:
                    now, at = group[a], firsts.value[int(to[a]), int(piece[a])]
                slot[a:z] = np.arange(at, at + z - a)
                at += z - a
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(to.astype(np.int32)), pa.array(slot)], [*names, "shard", "slot"])

    return order.mapInArrow(number, T.StructType([*fields, T.StructField("shard", whole), T.StructField("slot", number_)]))


def document_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 16), text_crc32: what is dealt instead of the texts."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
