"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

Texts are lower-cased, and every run of characters that aren't letters becomes
one space. For each language an interpolated Kneser-Ney model of order 5 gives
the probability of each character after the four before it: the highest order
counts n-grams, the lower ones count how many different characters precede
them, each order's discount is n1 / (n1 + 2 n2), kept within 0.1 and 0.95, and
the lowest is mixed with a uniform distribution. Languages stand in blocks of
BLOCK. The n-grams of a block stand in one sorted array of 64-bit hashes for
each order, with a matrix of log-probabilities beside it (complete for each
language of the block, whether or not it has the n-gram itself), so a character
costs one look-up a block at order 5 and falls to lower orders only where no
language of it has its n-gram; memory follows the n-grams, not their number
times all languages. The language of lowest cross-entropy a character wins.

A temperature, fitted on training texts kept out of the counts, turns the
differences of cross-entropy into a score; a text is rejected if its best
cross-entropy is above nearly all of those texts' (`rejected`).

Each language is learned from at most `max_rows` of its distinct texts, picked
by a hash of language and text; nothing else bounds the model, and all n-grams
of those texts count. Of a language's picked texts, in the order of their
hashes, every CALIBRATE-th is kept out of the counts, whatever their number, so
a language of fewer texts is learned from all. n-grams are counted, and each
block is built, on the executors; the driver takes the built blocks.

Defined cases: a null text or one without letters is `und` with score 0; a null
language is never learned; without training texts all is `und`; without texts
kept out the temperature is 20 and nothing but `und` is rejected; a text that
occurs often in a language counts once; equal cross-entropies go to the first
language by name; extra columns stay unread.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import drop, free_name, ship, slices, table
from textloom.llm.words import mix

ORDER = 5
#: Training texts of a language: so many at most; one in CALIBRATE of them is kept out of the counts.
MAX_ROWS, CALIBRATE = 2_000, 5
#: Languages whose n-grams share tables.
BLOCK = 8
#: The share of calibration texts that may be rejected.
REJECT = 0.001
PART_BYTES = 2 << 20

_ODD = (np.random.Generator(np.random.PCG64(31)).integers(0, 1 << 63, ORDER + 1, np.uint64) << np.uint64(1)) | np.uint64(1)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, each begun by a space; offsets of the texts."""
    low = [x.lower() for x in texts]
    raw = np.frombuffer((" " + " ".join(low)).encode("utf-32-le", "surrogatepass"), np.uint32) if low else np.empty(0, np.uint32)
    begin = np.cumsum([0, *[len(x) + 1 for x in low]])
    solid = letters()[raw]
    keep = solid.copy()
    if len(raw):
        keep[0] = True
        keep[1:] |= solid[:-1]
        keep[begin[:-1]] = True
    out = np.where(solid, raw, np.uint32(32))[keep]
    return out, np.append(0, np.cumsum(keep))[begin]


def keys(cps: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n code points that end at each position."""
    h = np.full(len(at), n, np.uint64) * _ODD[ORDER]
    for k in range(n):
        h += cps[at - k].astype(np.uint64) * _ODD[k]
    return mix(h)


class Sorted:
    """Sorted hashes with a directory by their top bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.append(hashes, np.uint64((1 << 64) - 1))
        self.bits = max(4, min(22, int(len(hashes)).bit_length()))
        tops = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.directory = np.searchsorted(self.hashes, tops).astype(np.int32)

    def find(self, want: np.ndarray) -> np.ndarray:
        """Where each hash stands, or -1."""
        at = self.directory[(want >> np.uint64(64 - self.bits)).astype(np.int64)]
        held = self.hashes[at]
        while True:
            behind = np.flatnonzero(held < want)
            if not len(behind):
                break
            at[behind] += 1
            held[behind] = self.hashes[at[behind]]
        return np.where((held == want) & (at < len(self.hashes) - 1), at, -1)


@dataclass
class Block:
    """The models of a few languages."""

    grams: list[Sorted] = field(default_factory=list)  # by order - 1
    log_p: list[np.ndarray] = field(default_factory=list)  # (n-grams, languages)
    contexts: list[Sorted] = field(default_factory=list)  # of order - 1 characters
    log_back: list[np.ndarray] = field(default_factory=list)  # (contexts, languages): the weight of the lower order
    discounts: list[np.ndarray] = field(default_factory=list)

    def log_probabilities(self, cps: np.ndarray, place: np.ndarray, at: np.ndarray, floor: float) -> np.ndarray:
        """(positions, languages) of the characters at `at`, each after those before it in its text."""
        total = np.zeros((len(at), self.log_p[0].shape[1]), np.float32)
        order = np.minimum(place[at] + 1, ORDER)
        active = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            here = order[active] >= n
            now = active[here]
            spots = at[now]
            row = self.grams[n - 1].find(keys(cps, spots, n))
            hit = row >= 0
            total[now[hit]] += self.log_p[n - 1][row[hit]]
            miss, spots = now[~hit], spots[~hit]
            ctx = self.contexts[n - 1].find(keys(cps, spots - 1, n - 1)) if n > 1 else np.zeros(len(spots), np.int64)
            some = ctx >= 0
            total[miss[some]] += self.log_back[n - 1][ctx[some]]
            active = np.concatenate((miss, active[~here]))
        total[active] += floor
        return total


@dataclass
class Model:
    languages: list[str]
    blocks: list[Block] = field(default_factory=list)
    floor: float = -20.0
    temperature: float = 20.0
    limit: float = float("inf")

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) mean -log p a character, and how many letters each text has."""
        cps, offsets = symbols(texts)
        n_letters = np.diff(np.append(0, np.cumsum(cps != 32))[offsets])
        starts, sizes = offsets[:-1], np.diff(offsets)
        place = np.arange(len(cps)) - np.repeat(starts, sizes)
        at = np.flatnonzero(place > 0)
        counts = np.maximum(sizes - 1, 0)
        some = counts > 0
        sums = np.zeros((len(texts), len(self.languages)))
        if some.any():
            first = (np.cumsum(counts) - counts)[some]
            for k, block in enumerate(self.blocks):
                found = block.log_probabilities(cps, place, at, self.floor)
                sums[some, k * BLOCK : k * BLOCK + found.shape[1]] = np.add.reduceat(found, first, axis=0)
        return -sums / np.maximum(counts, 1)[:, None], n_letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, best cross-entropies, rejections."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        h, n = self.entropies(texts)
        best = h.argmin(1)
        p = np.exp(-self.temperature * (h - h.min(1, keepdims=True)))
        score = np.where(n > 0, p.max(1) / p.sum(1), 0.0)
        low = h[np.arange(len(h)), best]
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), n.tolist(), strict=True)], score, low, (n == 0) | (low > self.limit)


def kneser_ney(grams: np.ndarray, counts: np.ndarray, owner: np.ndarray, n_lang: int, alphabet: int) -> Block:
    """From distinct (5-gram, language) rows with counts; grams is (rows, ORDER) code points, oldest first."""
    model = Block()
    level, weight, lang = grams, counts.astype(np.float64), owner
    levels = [(level, weight, lang)]
    for _ in range(ORDER - 1):
        # each distinct longer n-gram is one different character before its suffix
        short, inverse = np.unique(np.column_stack((level[:, 1:], lang)), axis=0, return_inverse=True)
        level, lang = short[:, :-1], short[:, -1].astype(np.int64)
        weight = np.bincount(inverse.ravel()).astype(np.float64)
        levels.append((level, weight, lang))
    levels.reverse()  # order 1 first
    lower: tuple[Sorted, np.ndarray] | None = None
    for n, (level, weight, lang) in enumerate(levels, 1):
        flat = level.astype(np.uint32)

        def hashed(columns: np.ndarray) -> np.ndarray:
            width = columns.shape[1]
            h = np.full(len(columns), width, np.uint64) * _ODD[ORDER]
            for k in range(width):
                h += columns[:, width - 1 - k].astype(np.uint64) * _ODD[k]
            return mix(h)

        key, ctx = hashed(flat), hashed(flat[:, :-1])
        c_keys, c_at = np.unique(ctx, return_inverse=True)
        total = np.zeros((len(c_keys), n_lang))
        kinds = np.zeros_like(total)
        np.add.at(total, (c_at, lang), weight)
        np.add.at(kinds, (c_at, lang), 1.0)
        discount = np.zeros(n_lang)
        for i in range(n_lang):
            n1, n2 = (weight[lang == i] == 1).sum(), (weight[lang == i] == 2).sum()
            discount[i] = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5))
        seen = total > 0
        back = np.where(seen, discount[None, :] * kinds / np.where(seen, total, 1), 1.0)
        if not len(c_keys):  # nothing learned: the lower order has all the weight
            c_keys, back = np.zeros(1, np.uint64), np.ones((1, n_lang))
        g_keys, g_row, g_at = np.unique(key, return_index=True, return_inverse=True)
        own = np.zeros((len(g_keys), n_lang))
        np.add.at(own, (g_at, lang), np.maximum(weight - discount[lang], 0) / total[c_at, lang])
        if lower is None:
            below = np.full((len(g_keys), n_lang), 1 / alphabet)
        else:
            spot = lower[0].find(hashed(flat[g_row][:, 1:]))
            below = lower[1][spot]
        p = own + back[c_at[g_row]] * below
        table = Sorted(g_keys)
        model.grams.append(table)
        model.log_p.append(np.log(p).astype(np.float32))
        model.contexts.append(Sorted(c_keys))
        model.log_back.append(np.log(back).astype(np.float32))
        model.discounts.append(discount)
        lower = (table, p)
    return model


def _sample(train: DataFrame, max_rows: int, text_col: str, lang_col: str) -> DataFrame:
    """(lang, rank, text): at most max_rows distinct texts of each language, ranked from 1 by a hash."""
    lang, text = train[lang_col].cast("string"), train[text_col].cast("string")
    rows = train.select(F.xxhash64(lang, text).alias("spot"), lang.alias("lang"), text.alias("text")).where("lang is not null and text is not null")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a number for each language
    share = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(min(1.0, max_rows / n)))]) if totals else F.create_map(F.lit(""), F.lit(0.0))
    picked = rows.where(F.pmod("spot", F.lit(1 << 40)) / float(1 << 40) < share[F.col("lang")])
    # equal rows become one before any of them meets others, so a hot text stays small
    once = picked.groupBy("lang", "spot").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("spot"))
    return table(once.select("lang", rank.alias("rank"), "text").where(F.col("rank") <= max_rows), "lang-sample")


def fit(train: DataFrame, max_rows: int = MAX_ROWS, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on the rows of train with text and language, on at most max_rows of each language's texts."""
    spark = train.sparkSession
    ship(spark)
    sample = _sample(train, max_rows, text_col, lang_col)
    names = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not names:
        return Model([])
    index = {k: i for i, k in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES):
            langs = np.array([index[x] for x in part.column(0).to_pylist()])
            texts = part.column(1).to_pylist()
            for i in np.unique(langs).tolist():
                cps, offsets = symbols([texts[k] for k in np.flatnonzero(langs == i).tolist()])
                place = np.arange(len(cps)) - np.repeat(offsets[:-1], np.diff(offsets))
                at = np.flatnonzero(place >= ORDER - 1)
                _, first, times = np.unique(keys(cps, at, ORDER), return_index=True, return_counts=True)
                spot = at[first]
                wide = np.stack([cps[spot - k] for k in range(ORDER - 1, -1, -1)], 1).astype("<u4")
                gram = [wide[k].tobytes() for k in range(len(wide))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), i, np.int32)), pa.array(gram, pa.binary()), pa.array(times.astype(np.int64))], ["lang", "gram", "n"])

    learned = sample.where(F.col("rank") % CALIBRATE != 0).select("lang", "text")
    counted = table(learned.mapInArrow(count, "lang int, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams")
    alphabet = counted.select(F.substring("gram", 4 * ORDER - 3, 4)).distinct().count() + 1
    n_lang = len(names)

    def build(rows: pa.Table) -> pa.Table:
        k = rows["block"][0].as_py()
        order = np.lexsort((np.array(rows["gram"].to_pylist(), object), rows["lang"].to_numpy()))
        grams = np.frombuffer(b"".join(rows["gram"].to_pylist()), "<u4").reshape(-1, ORDER).astype(np.int64)[order]
        made = kneser_ney(grams, rows["n"].to_numpy()[order], rows["lang"].to_numpy().astype(np.int64)[order] - k * BLOCK, min(BLOCK, n_lang - k * BLOCK), alphabet)
        return pa.table({"block": pa.array([k], pa.int32()), "model": pa.array([pickle.dumps(made)], pa.binary())})

    blocks = counted.withColumn("block", F.floor(F.col("lang") / BLOCK).cast("int")).groupBy("block").applyInArrow(build, "block int, model binary")
    found = {r["block"]: pickle.loads(r["model"]) for r in blocks.collect()}  # noqa: S301 - made above
    if not found:
        return Model([])
    empty = np.empty((0, ORDER), np.int64)
    made = [found.get(k) or kneser_ney(empty, empty[:, 0], empty[:, 0], min(BLOCK, n_lang - k * BLOCK), alphabet) for k in range(-(-n_lang // BLOCK))]
    model = Model(names, made, float(-np.log(alphabet)))
    model = calibrated(model, sample.where(F.col("rank") % CALIBRATE == 0), index)
    drop(sample, counted)
    return model


def calibrated(model: Model, rows: DataFrame, index: dict[str, int]) -> Model:
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES):
            h, n = held.value.entropies(part.column(2).to_pylist())
            some = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays([pa.array([index[x] for x in part.column(0).to_pylist()], pa.int32()).take(pa.array(some)), pa.array(list(h[some]), pa.list_(pa.float64()))], ["lang", "h"])

    found = rows.mapInArrow(run, "lang int, h array<double>").toArrow()
    if found.num_rows:
        h, lang = np.stack(found["h"].to_numpy(zero_copy_only=False)), found["lang"].to_numpy()
        rest = h - h.min(1, keepdims=True)

        def loss(t: float) -> float:
            return float((t * rest[np.arange(len(lang)), lang] + np.log(np.exp(-t * rest).sum(1))).mean())

        model.temperature = min((2.0**k for k in range(-1, 9)), key=loss)
        model.limit = float(np.quantile(h.min(1), 1 - REJECT))
    return model


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs, with lang_pred, score, cross_entropy and rejected."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # BLOCK numbers for each n-gram of the bounded sample
    own = free_name(keep, "text")
    rows = docs.select(*[docs[c] for c in keep], F.coalesce(docs[text_col], F.lit("")).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES, own):
            lang, score, h, rejected = held.value.predict(part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang), pa.array(score, pa.float64()), pa.array(h, pa.float64()), pa.array(rejected)], [*part.schema.names[:-1], "lang_pred", "score", "cross_entropy", "rejected"])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *more]))
