"""The pipeline's rows against a version that does every stage by brute force, one document at a time."""

import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from test_operators import brute_components  # noqa: E402

import corpus_pipeline  # noqa: E402
from textloom.llm import packing, pii, quality  # noqa: E402


def near_dedup(docs):
    classes = brute_components(docs.items(), 5, 80)
    return {i: t for i, t in docs.items() if classes[i][1] == i}


def cut_repeats(docs, length=20):
    seen, out = set(), {}
    for i in sorted(docs):
        spans = [m.span() for m in re.finditer("[^\x20\x09-\x0d]+", docs[i])]
        words = [docs[i][a:b] for a, b in spans]
        gone, new = [False] * len(words), []
        for s in range(len(words) - length + 1):
            key = tuple(words[s : s + length])
            if key in seen or key in new:
                gone[s : s + length] = [True] * length
            new.append(key)
        seen.update(new)
        text, at, k = "", 0, 0
        while k < len(words):
            if not gone[k]:
                k += 1
                continue
            e = k
            while e < len(words) and gone[e]:
                e += 1
            text += docs[i][at : spans[k][0]]
            at = spans[e][0] if e < len(words) else spans[e - 1][1]
            k = e
        out[i] = text + docs[i][at:]
    return out


def test_run_equals_brute_force(spark, data):
    from tokenizers import Tokenizer

    table, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    docs = {r["doc_id"]: r["text"] for r in table.collect()}
    model = quality.fit(table, quality.ratings_of(labels), 3)
    kept = {i: t for i, t in docs.items() if model.tails(quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])))[0, -1] >= 0.5}
    assert 0 < len(kept) < len(docs)
    left = cut_repeats(near_dedup(kept))
    patterns = [pii.pattern(t, s) for t in left.values() for base in [pii.base_spans(t)] for s in base + pii.loose_spans(t, base)]
    keys, counts = np.unique(np.array(patterns, np.int64), return_counts=True)
    spans = pii.train(keys, counts.astype(np.int64))
    left = {i: pii.redact(t, spans) for i, t in left.items()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = []
    for i, text in left.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        stops = list(range(len(ids), 0, -1024))[::-1]
        for k, stop in enumerate(stops):
            start = stops[k - 1] if k else 0
            want.append((i, k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
    rows = corpus_pipeline.run(spark, data).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in sequences.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    values, n = np.unique([r["length"] for r in rows], return_counts=True)
    assert len(sequences) <= 1.005 * packing.least_bins(values, n, 1024) + 1


def test_extra_columns_go_through_every_stage(spark, data, tmp_path):
    """Columns with names that the operators use themselves stay as they are, and nulls and empty tables pass."""
    from pyspark.sql import functions as F

    table = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    odd = table.withColumns({c: F.lit(c) for c in ("rep", "kept", "label", "bucket", "node", "tail_top", "seeds", "owned", "spans", "grade", "__text")})
    odd = odd.unionByName(odd.limit(3)).unionByName(odd.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10_000)).unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for name, frame in (("odd", odd), ("none", odd.limit(0))):
        frame.write.parquet(f"{tmp_path}/{name}/0")
        here = spark.read.parquet(f"{tmp_path}/{name}/0")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
            stage(spark, here, data).write.parquet(f"{tmp_path}/{name}/{k}")
            here = spark.read.parquet(f"{tmp_path}/{name}/{k}")
            if k < len(corpus_pipeline.STAGES):
                assert here.columns == odd.columns
                assert here.where("rep <> 'rep' or __text <> '__text'").count() == 0
                if k == 2:
                    named = here.where("doc_id is not null")
                    assert named.count() == named.select("doc_id").distinct().count()
        assert (here.count() > 0) == (name == "odd")


def test_texts_without_id_stay_their_own(spark, data):
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [(None, f"one {passage}"), (None, f"two {passage}"), (None, "three"), (4, f"four {passage}"), (5, f"five {passage}"), (5, "other")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, n_chars long").coalesce(1)
    found = corpus_pipeline.substring_dedup(spark, docs, data)
    assert found.columns == docs.columns
    want = [(None, f"one {passage}"), (None, "two "), (None, "three"), (4, "four "), (5, "five "), (5, "other")]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((i, t, len(t)) for i, t in want), key=repr)
