"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w.x - t_k): one weight vector over hashed features of
the text serves all grades, with ordered thresholds t_1 < t_2 < ... It gives
the expected grade and the probability of each tail; a document is selected if
its tail probability of the top grade is high enough.

Of the hashed features only those count that at least `LEAST_SEEN` rated texts
have and whose mean grade departs from the rest by `LEAST_Z` standard errors,
so that a long text's many ordinary words don't drown the few that tell.
Features are present or absent: words without their punctuation, their first 4
and 5 bytes, what trails a word, and binned shares of the text (repeated words,
capitals, trailing marks, tokens without letters). The classifier is fitted on
the driver on at most about `max_rows` rated documents, picked by a hash of
their ids; rating and id are never features. Scoring is one pass over whole texts.

Defined cases: a null or empty text has features of an empty text; several
ratings of one id count as their mean, rounded down, and of unlike texts of an
id the least is learned from; a null grade or id is no rating;
without ratings every document is kept with null figures; repeated rows are
scored alike; extra columns stay untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.chunking import digests
from textloom.llm.common import free_name, ship, slices, text_bytes
from textloom.llm.words import LOWER, Words

BITS = 20
MAX_ROWS = 12_000
LEAST_SEEN, LEAST_Z = 5, 3.5
PART_BYTES = 1 << 20

LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[ord("A") : ord("Z") + 1] = LETTER[128:] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[ord("A") : ord("Z") + 1] = True
_SALT = {k: np.uint64(0x9E3779B97F4A7C15 * (i + 3) & (1 << 64) - 1) for i, k in enumerate(("word", "four", "five", "tail", "bin"))}


def _fold(h: np.ndarray, kind: str) -> np.ndarray:
    h = (h ^ _SALT[kind]) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct hashed features."""
    words = Words(data, offsets, lower=False)
    n = len(data)
    s, e = words.starts, words.ends
    at = np.arange(n)
    letter = LETTER[data]
    ahead = np.minimum.accumulate(np.where(letter, at, n)[::-1])[::-1] if n else at
    behind = np.maximum.accumulate(np.where(letter, at, -1)) if n else at
    bare = ahead[s] >= e if len(s) else np.zeros(0, bool)
    cs = np.where(bare, s, ahead[s]) if len(s) else s
    ce = np.where(bare, e, behind[e - 1] + 1) if len(s) else e
    low = LOWER[data]
    if len(s):
        word = _fold(digests(low, cs, ce), "word")
        four = _fold(digests(low, cs, np.minimum(cs + 4, ce)), "four")
        five = _fold(digests(low, cs, np.minimum(cs + 5, ce)), "five")
        tail = _fold(digests(data, ce, np.minimum(e, ce + 4)), "tail")
        marks = e - ce >= 2
        capital = CAPITAL[data[np.minimum(cs + 1, ce - 1)]] & (ce - cs > 1)
    out = []
    for a, c in zip(words.first.tolist(), words.counts.tolist(), strict=False):
        if not c:
            out.append(_fold(np.array([1], np.uint64), "bin"))
            continue
        z = a + c
        w = np.unique(word[a:z])
        shares = (len(w) / c, capital[a:z].mean(), marks[a:z].mean(), bare[a:z].mean(), min(1.0, np.log2(c) / 16))
        bins = np.array([(k << 8) | int(x * 10) for k, x in enumerate(shares, 1)], np.uint64)
        out.append(np.unique(np.concatenate((w, four[a:z], five[a:z], tail[a:z], _fold(bins * np.uint64(0xC2B2AE3D27D4EB4F), "bin")))))
    return out


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """(rows, thresholds): P(grade >= k)."""
        score = np.array([self.weights[x].sum() for x in rows])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = 20, rate: float = 0.3, decay: float = 1e-5, seed: int = 9) -> Ordinal:
    """Likelihood of the cumulative logits by AdaGrad on batches; the gaps between thresholds stay positive by their logarithm."""
    rng = np.random.Generator(np.random.PCG64(seed))
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    seen = np.bincount(flat, minlength=1 << BITS)
    mean = np.bincount(flat, np.repeat(grades, sizes), 1 << BITS) / np.maximum(seen, 1)
    z = (mean - grades.mean()) * np.sqrt(seen) / max(1e-9, grades.std())
    telling = (seen >= LEAST_SEEN) & (np.abs(z) >= LEAST_Z)
    rows = [np.append(r[telling[r]], -1) for r in rows]  # the last weight takes texts without any, and stays 0
    w, g2 = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-3)
    share = np.clip([(grades >= k).mean() for k in range(1, n_grades)], 1e-3, 1 - 1e-3)
    share = np.minimum.accumulate(share - np.arange(n_grades - 1) * 1e-4)
    t = np.log((1 - share) / share)
    first, gaps = t[0], np.log(np.maximum(np.diff(t), 1e-3))
    p2 = np.full(n_grades - 1, 1e-3)
    sizes = np.array([len(r) for r in rows])
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            flat = np.concatenate([rows[i] for i in pick])
            lens = sizes[pick]
            score = np.add.reduceat(w[flat], np.cumsum(lens) - lens)
            t = first + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
            cdf = 1 / (1 + np.exp(np.clip(score[:, None] - t[None, :], -50, 50)))  # P(grade < k)
            full = np.concatenate((np.zeros((len(pick), 1)), cdf, np.ones((len(pick), 1))), 1)
            y = grades[pick]
            i = np.arange(len(pick))
            hi, lo_ = full[i, y + 1], full[i, y]
            p = np.maximum(hi - lo_, 1e-9)
            d_hi, d_lo = hi * (1 - hi), lo_ * (1 - lo_)
            d_score = (d_hi - d_lo) / p  # of the loss
            values = np.repeat(d_score, lens)
            keys, inverse = np.unique(flat % ((1 << BITS) + 1), return_inverse=True)
            grad = np.bincount(inverse, values) / len(pick) + decay * w[keys]
            g2[keys] += grad * grad
            w[keys] -= rate * grad / np.sqrt(g2[keys])
            w[-1] = 0
            d_t = np.zeros(n_grades - 1)
            np.add.at(d_t, y[y < n_grades - 1], -(d_hi / p)[y < n_grades - 1])
            np.add.at(d_t, y[y > 0] - 1, (d_lo / p)[y > 0])
            d_t /= len(pick)
            step = np.concatenate(([d_t.sum()], np.exp(gaps) * np.cumsum(d_t[::-1])[::-1][1:]))
            p2 += step * step
            step = rate * step / np.sqrt(p2)
            first -= step[0]
            gaps = np.clip(gaps - step[1:], -5, 5)
    return Ordinal(w[:-1].astype(np.float32), first + np.concatenate(([0.0], np.cumsum(np.exp(gaps)))))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Ordinal | None:
    """Fit on about max_rows of ratings (doc_id, grade) at most; None where no text is rated."""
    ship(docs.sparkSession)
    rated = ratings.where("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("__rated")).agg(F.floor(F.avg("grade")).cast("int").alias("__grade"))
    spot = F.pmod(F.xxhash64("__rated"), F.lit(1 << 30)) / float(1 << 30)
    picked = rated.where(spot < min(1.0, max_rows / max(1, rated.count())))
    texts = docs.select(docs[id_col].cast("long").alias("__rated"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    # max_rows bounds what is broadcast, so texts that aren't picked don't travel; an id's rows become one before they meet
    once = texts.join(F.broadcast(picked), "__rated").groupBy("__rated", "__grade").agg(F.min("text").alias("text"))
    both = once.select("text", "__grade", F.xxhash64("__rated").alias("__order"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES):
            rows = [x.astype("<i4").tobytes() for x in features(*text_bytes(part.column(0)))]
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), pa.array(rows, pa.binary())], ["o", "grade", "x"])

    found = both.mapInArrow(run, "o long, grade int, x binary").toArrow()
    if not found.num_rows:
        return None
    order = np.argsort(found["o"].to_numpy(), kind="stable")
    rows = [np.frombuffer(x, "<i4") for x in found["x"].to_pylist()]
    return fit_ordinal([rows[i] for i in order], np.clip(found["grade"].to_numpy()[order], 0, n_grades - 1), n_grades)


def score(docs: DataFrame, model: Ordinal | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs, with expected_grade and tail_top (the probability of the top grade)."""
    spark = docs.sparkSession
    if model is None:
        return docs.select(*[docs[c] for c in keep], F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_top"))
    held = spark.sparkContext.broadcast(model)  # 2**BITS numbers, whatever the corpus
    own = free_name(keep, "text")
    rows = docs.select(*[docs[c] for c in keep], F.coalesce(docs[text_col], F.lit("")).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES, own):
            tails = held.value.tails(features(*text_bytes(part.column(part.num_columns - 1))))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(tails.sum(1)), pa.array(tails[:, -1])], [*part.schema.names[:-1], "expected_grade", "tail_top"])

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_top", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades 0 to 2 from the labels table: a point for quality and one for not being toxic."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def select(docs: DataFrame, model: Ordinal | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose probability of the top grade is at least `least`."""
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES, text_col):
            yield part.filter(pa.array(held.value.tails(features(*text_bytes(part.column(at))))[:, -1] >= least))

    return docs.mapInArrow(run, docs.schema)
