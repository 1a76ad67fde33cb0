"""Near-duplicate classes: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

1. Each text's distinct word shingles are hashed once; the hash gives a bin
   and a value, and the least value of a bin is its signature. Empty bins
   borrow from full ones by their own random probing (optimal densification).
   6 bins make a band, 48 bands an array of bucket keys: two sets of likeness
   0.8 share no bucket with probability under 5e-7.
2. Equal sets are classed at once by their digest; one representative of each goes on.
3. In each bucket of two or more, the member with most bucket mates is the
   centre, and only the star of centre and members is verified on full sets.
4. Components of the confirmed links label the members. A bucket whose members
   other than the centre all have one label is settled. In the others, every
   member outside the bucket's most frequent label is compared, in blocks, with
   all members of other labels; only links are passed on, so no pair of a
   large group is ever a row. Nothing is capped, so no link between different
   texts is lost but for the probability above.

Texts are shuffled once, and only those of candidates go on. Stars and blocks
are dealt by (centre or bucket, salt), so no task gets a whole large group.

Defined cases: no words, no text or a null text: an empty set, linked with
nothing; fewer words than a shingle: one shingle; repeated rows have one class
(an id should have one text only); a null id is linked with nothing; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import drop, release, rows_of, ship, slices, table, text_bytes, two
from textloom.llm.components import components
from textloom.llm.words import mix, shingle_sets

ROWS, BANDS = 6, 48
BINS = ROWS * BANDS
#: Members that meet a centre's, or a block's, texts in one stretch.
STRETCH = 256
PART_BYTES = 4 << 20

_probe = np.random.Generator(np.random.PCG64(77)).integers(0, BINS, (4096, BINS))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BINS) least values; sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    h = mix(np.concatenate(sets) ^ np.uint64(0xA0761D6478BD642F))
    row = np.repeat(np.arange(len(sets)), sizes)
    slot = row * BINS + ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    value = (h & np.uint64(0xFFFFFFFF))
    none = np.uint64(1 << 40)
    flat = np.full(len(sets) * BINS, none)
    np.minimum.at(flat, slot, value)
    sig = flat.reshape(-1, BINS)
    full = sig != none
    out = sig.copy()
    left = np.flatnonzero(~full.all(1))
    for k in range(len(_probe)):
        if not len(left):
            break
        donor = _probe[k]
        want = (out[left] == none) & full[left][:, donor]
        part = out[left]
        part[want] = sig[left][:, donor][want]
        out[left] = part
        left = left[(part == none).any(1)]
    for i in left:  # beyond all probes: the next full bin
        at = np.flatnonzero(full[i])
        empty = np.flatnonzero(out[i] == none)
        out[i, empty] = sig[i, at[np.searchsorted(at, empty) % len(at)]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 64-bit bucket keys; the band is part of the key."""
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), len(sig), 0)
    for k in range(ROWS):
        key = mix(key ^ (sig[:, k::ROWS] + np.uint64(k << 40)))
    return key.astype(np.int64)


def _sets(part: pa.RecordBatch, column: str, words: int) -> list[np.ndarray]:
    return shingle_sets(*text_bytes(part.column(part.schema.get_field_index(column))), words)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a 128-bit digest of the set), bands (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES):
            sets = _sets(part, "text", words)
            some = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [[]] * len(sets)
            a, b = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            if some:
                keys = band_keys(signatures([sets[i] for i in some]))
                for i, k in zip(some, keys, strict=True):
                    bands[i] = k
                with np.errstate(over="ignore"):
                    a[some] = [np.bitwise_xor.reduce(mix(sets[i] + np.uint64(1))).astype(np.int64) for i in some]
                    b[some] = [mix(sets[i] ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64).astype(np.int64) for i in some]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def _alike(own: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets reach the likeness with `own`."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    same = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * same >= percent * (len(own) + sizes - same)


def _stars(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (centre, member, salt) whose sets are alike. Each stretch of a star holds its centre's text once."""
    members = pairs.join(texts.withColumnRenamed("rep", "member"), "member").select("centre", "salt", F.lit(1).alias("role"), "member", "text")
    heads = pairs.select("centre", "salt").distinct().join(texts.withColumnRenamed("rep", "centre"), "centre").select("centre", "salt", F.lit(0).alias("role"), F.col("centre").alias("member"), "text")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heads.union(members).repartition(n, "centre", "salt").sortWithinPartitions("centre", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for part in slices(batches, PART_BYTES):
            centre, role, member = (part.column(i).to_numpy() for i in (0, 2, 3))
            sets = _sets(part, "text", words)
            heads = np.flatnonzero(role == 0).tolist()
            found: list[tuple[int, int]] = []
            for a, z in zip([0, *heads], [*heads, len(role)], strict=True):
                if a < z and role[a] == 0:
                    own, a = sets[a], a + 1
                if a < z:
                    ok = _alike(own, sets[a:z], percent)
                    found += zip(centre[a:z][ok].tolist(), member[a:z][ok].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between labels inside unsettled buckets (bucket, rep, label, usual, bands, text).

    `usual` is the bucket's most frequent label. The other members are dealt
    into blocks; each block's task sees them first (role 0), then all members
    of the bucket, and passes one link on for each pair of labels it joins.
    """
    spark = members.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with_text = members
    rare = with_text.where("label <> usual").withColumn("block", F.pmod(F.xxhash64("rep"), F.greatest(F.lit(1), F.ceil(F.col("n_rare") / STRETCH))).cast("int"))
    blocks = rare.select("bucket", "block").distinct()
    stretches = F.ceil(F.col("n_all") / (4 * STRETCH)).cast("int")
    cols = ["rep", "label", "bands", "text"]
    queries = rare.select("bucket", "block", F.explode(F.sequence(F.lit(0), stretches - 1)).alias("stretch"), F.lit(0).alias("role"), *cols)
    against = with_text.join(blocks, "bucket").select("bucket", "block", F.pmod(F.xxhash64("rep", F.lit(1)), stretches).cast("int").alias("stretch"), F.lit(1).alias("role"), *cols)
    # the far side of a block is cut into stretches too, each with a copy of the block
    dealt = queries.union(against).repartition(n, "bucket", "block", "stretch").sortWithinPartitions("bucket", "block", "stretch", "role").select("bucket", "block", "stretch", "role", *cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, joined = None, [], set()
        for part in slices(batches, PART_BYTES):
            at = list(zip(*(part.column(i).to_pylist() for i in (0, 1, 2)), strict=True))
            role, rep, label = (part.column(i).to_pylist() for i in (3, 4, 5))
            bands = np.stack(part.column(6).to_numpy(zero_copy_only=False))
            sets = _sets(part, "text", words)
            found: list[tuple[int, int]] = []
            i = 0
            while i < len(at):
                if at[i] != now:
                    now, block, joined = at[i], [], set()
                j = i
                while j < len(at) and at[j] == now and role[j] == role[i]:
                    j += 1
                if role[i] == 0:
                    block += [(rep[k], label[k], bands[k], sets[k]) for k in range(i, j)]
                else:
                    sizes = np.array([len(s) for s in sets[i:j]])
                    labels = np.array(label[i:j])
                    for r, l, bs, own in block:
                        able = (labels != l) & (100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own)))
                        # a pair is taken in the first bucket that it shares
                        shared = bands[i:j] == bs
                        able &= bs[shared.argmax(1)] == now[0]
                        spots = [k for k in np.flatnonzero(able).tolist() if (l, int(labels[k])) not in joined]
                        if not spots:
                            continue
                        for k in np.array(spots)[_alike(own, [sets[i + k] for k in spots], percent)].tolist():
                            if (l, int(labels[k])) not in joined:
                                joined |= {(l, int(labels[k])), (int(labels[k]), l)}
                                found.append((r, rep[i + k]))
                i = j
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable over links), kept (whether that is its own)."""
    spark = docs.sparkSession
    ship(spark)
    texts = two(docs, id_col, text_col)
    signed = table(_signed(texts, words), "signed")
    able = signed.where("doc_id is not null and n_shingles > 0")
    equal = table(able.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "sets")
    rows = equal.select("rep", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    mates = table(rows.join(sizes, "bucket"), "mates")
    links, spent = None, [mates]
    if rows_of(mates):
        degree = mates.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("degree"))
        hubs = mates.join(degree, "rep").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("rep")).alias("minus"))).alias("hub"))
        centres = hubs.select("bucket", (-F.col("hub.minus")).alias("centre"), F.col("hub.degree").alias("degree"))
        starred = mates.join(centres, "bucket").where("rep <> centre")
        # a centre meets a member in up to BANDS buckets, so its degree bounds its star; stretches are dealt out before any join on it
        salt = F.pmod(F.xxhash64("rep"), F.ceil(F.col("degree") * 4 / (BANDS * STRETCH))).cast("int")
        salted = table(starred.select("centre", F.col("rep").alias("member"), salt.alias("salt")).distinct(), "stars")
        wanted = degree.select("rep")
        candidates = table(two(docs, id_col, text_col).join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).withColumnRenamed("doc_id", "rep"), "candidates")
        release(spark)
        first = table(_stars(salted, candidates, words, percent), "links")
        labels = first.select(F.col("a").alias("node"), F.col("b").alias("label"))
        if rows_of(first):
            labels = components(first)
            spent.append(labels)
        labelled = starred.select("bucket", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label"))
        per_label = labelled.groupBy("bucket", "label").agg(F.count("*").alias("k"))
        open_ = per_label.groupBy("bucket").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("k", "label")).alias("usual"), (F.sum("k") - F.max("k")).alias("n_rare"), F.sum("k").alias("n_all")).where("labels > 1").select("bucket", "usual", "n_rare", "n_all")
        unsettled = table(labelled.join(open_, "bucket"), "unsettled")
        links = first
        spent += [salted, candidates, unsettled, first]
        if rows_of(unsettled):
            release(spark)
            members = table(unsettled.join(equal.select("rep", "bands"), "rep").join(candidates, "rep"), "blocks")
            more = table(_blocks(members, words, percent), "links")
            links = links.union(more)
            spent += [members, more]
    if links is None or not rows_of(links):
        label = signed.join(equal.select("set_a", "set_b", F.col("rep").alias("label")), ["set_a", "set_b"], "left")
    else:
        final = components(links)
        found = equal.select("set_a", "set_b", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
        label = signed.join(found.select("set_a", "set_b", F.coalesce("label", "rep").alias("label")), ["set_a", "set_b"], "left")
    drop(*spent)  # the labels' edges, the sets and the signed rows are what the result reads
    own = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("label"))
    return label.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
