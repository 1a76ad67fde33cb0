"""The operators through Spark, on fixtures with the awkward cases, against brute force."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from textloom.llm import bpe, chunking, jpeg, langid, minhash, packing, pii, quality, sharding, substrings  # noqa: E402
from textloom.llm.components import components  # noqa: E402

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids_crc32 long, rep long, bucket string, kept string, label string"


def words_of(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def rows():
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeated rows, personal data."""
    rng = random.Random(8)
    passage = " ".join(words_of(rng, 60))
    base = words_of(rng, 120)
    texts = [None, "", " \n\t ", "one", "one two", "One  TWO", "x " * 20_000, passage, "before " + passage + " after", passage + " " + passage]
    for k in range(40):
        w = list(base)
        for i in rng.sample(range(len(w)), k % 9):
            w[i] = f"new{k}_{i}"
        texts.append(" ".join(w))
    texts += [" ".join(words_of(rng, rng.randrange(1, 200))) for _ in range(40)]
    texts += [texts[12], texts[12], "write to ann@mail.example.com or +1 (743) 555-3824, card 4111 1111 1111 1111 at 10.1.2.300 and 10.1.2.30", "ñandú " * 50]
    made = [(i, t, "en", "s", None, 5, 6, "b", "k", "l") for i, t in enumerate(texts)]
    made.append(made[15])
    made.append((None, "a null id with some words", None, None, None, 5, 6, "b", "k", "l"))
    return made


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return [r.asDict() for r in df.collect()]


def test_bpe(docs, none):
    import tiktoken

    e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load(RANKS, PATTERN).ranks, special_tokens={})
    want = sorted((i is None, i, hashlib.sha256(np.array(e.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows())
    found = got(bpe.encode_digests(docs, RANKS, PATTERN))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == want
    assert bpe.encode_digests(none, RANKS, PATTERN).count() == 0
    assert {bytes(r["decoded"]) for r in got(bpe.encode(docs, RANKS, PATTERN))} == {(t or "").encode() for _, t, *_ in rows()}


def test_fingerprints(docs, none):
    found = got(chunking.edited_likeness(docs))
    ordered = sorted(((-1 if i is None else i, t or "") for i, t, *_ in rows()))
    want = {}
    for (i, x), (_, y) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        n = len(x)
        want.setdefault(i, []).append((n, hashlib.sha256((x[: n - n // 2] + y[: n // 2]).encode()).hexdigest()))
    have = {}
    for r in found:
        have.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append((r["n_chars"], r["edited_sha256"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    same = {r["fingerprint"] for r in found if r["doc_id"] in (12, 90, 91)}
    assert len(same) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert chunking.edited_likeness(none).count() == 0
    assert chunking.fingerprints(docs).count() == len(rows())


def test_one_document_is_its_own_next(spark):
    one = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    r = chunking.edited_likeness(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert r["near_next"] == 1.0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    found = got(packing.pack(packing.pieces(docs, RANKS, PATTERN, 2, 1024), 1024))
    want = []
    for i, text, *_ in rows():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = list(range(len(ids), 0, -1024))[::-1]
        for k, stop in enumerate(cuts):
            start = cuts[k - 1] if k else 0
            want.append((i is None, i, k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(want)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in sequences.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 1024
    lengths = np.array([r["length"] for r in found])
    values, counts = np.unique(lengths, return_counts=True)
    assert len(sequences) <= packing.least_bins(values, counts, 1024) + 1
    assert packing.pack(packing.pieces(none, RANKS, PATTERN, 2, 1024), 1024).count() == 0


def test_added_tokens_and_long_blanks_as_the_json_file_has_them(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"  \n{end}   \n z", f"<{end}>", "<|endoftext|", "<|ENDOFTEXT|>", "a" + " " * 2_000_000 + "b"]
    found = got(packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, PATTERN, 2, 1 << 22))
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for x in texts]
    assert [(r["doc_id"], r["length"], r["ids_crc32"]) for r in sorted(found, key=lambda r: r["doc_id"])] == [(i, len(x), zlib.crc32(x.tobytes())) for i, x in enumerate(want)]


@pytest.mark.parametrize("n_shards", [1, 7, 200])
def test_sharding(docs, none, n_shards):
    found = got(sharding.shard(sharding.document_rows(docs), n_shards, seed=3))
    sizes = {}
    for r in found:
        sizes.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
    per = [len(sizes.get(k, [])) for k in range(n_shards)]
    assert max(per) - min(per) <= 1
    want = sorted((i is None, i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in found) == want
    assert sharding.shard(sharding.document_rows(none), n_shards).count() == 0


def test_media(docs, none):
    by_id = {i: (t or "").encode() for i, t, *_ in rows()}
    for r in got(jpeg.text_media(docs)):
        payload = jpeg.padded(by_id[r["doc_id"]]).tobytes()
        assert bytes(r["payload"]) == payload
        assert len(payload) % 576 == 0
        assert len(payload) > 0
        assert r["n_bytes"] == len(by_id[r["doc_id"]])
    assert jpeg.text_media_digests(none).count() == 0
    media = jpeg.text_media(docs.limit(3)).select(F.lit(1).alias("k"), "media").union(docs.limit(1).select(F.lit(2), F.lit(b"no image"))).union(docs.limit(1).select(F.lit(3), F.lit(None).cast("binary")))
    assert {r["id"]: r["width"] for r in got(jpeg.thumbnails(media, "k", "media"))} == {1: 192, 2: None, 3: None}


def test_pii(docs, none):
    found = {r["doc_id"]: r for r in got(pii.find(docs))}
    assert found[92]["n_email"] == 1
    assert found[92]["n_phone"] == 1
    assert found[92]["n_card"] == 1
    assert found[92]["n_ip"] == 1
    assert found[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert found[11]["spans"] == ""
    assert pii.find(none).count() == 0
    clean = {r["doc_id"]: r["text"] for r in got(pii.redacted(docs))}
    assert "ann@" not in clean[92]
    assert clean[0] is None
    assert clean[13] == next(t for i, t, *_ in rows() if i == 13)


def brute_removals(table, length):
    seen, out = set(), {}
    for i, text in table:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = [False] * len(w)
        new = []
        for s in range(len(w) - length + 1):
            key = tuple(w[s : s + length])
            if key in seen or key in new:
                gone[s : s + length] = [True] * length
            new.append(key)
        seen.update(new)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_substrings(spark, docs, none):
    once = {}
    for i, t, *_ in rows():
        once[-1 if i is None else i] = t
    want = brute_removals([(k, once[k]) for k in sorted(once) if k != 6], 20)
    frame = docs.where("doc_id <> 6 or doc_id is null").dropDuplicates(["doc_id"])
    found = {-1 if r["doc_id"] is None else r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got(substrings.removals(frame))}
    assert found == want
    assert substrings.removals(none).count() == 0
    long = {r["doc_id"]: r for r in got(substrings.removals(docs))}[6]
    assert long["n_words"] == 20_000
    assert long["n_removed"] == 19_999  # the first window stays where it starts, all that follow equal it
    texts = {r["doc_id"]: r["text"] for r in got(substrings.without_repeats(frame))}
    assert texts[8] == "before after"
    assert len(texts[9].split()) == 0


def test_repeated_ids_are_one_document(spark):
    text = " ".join(f"v{i}" for i in range(40))
    twice = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in got(substrings.removals(twice))) == [(1, 0), (1, 0), (2, 40)]


def test_rows_without_id_and_unlike_rows_of_an_id_keep_their_own_texts(spark):
    """Each row without an id is a document; rows of one id are judged together but lose words of their own texts only."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    texts = [(None, f"one {a}"), (None, f"two {a}"), (None, b), (None, "short"), (None, None), (-(1 << 63), f"least {a}"), (3, c), (5, f"x {c}"), (5, f"{d} y {b}"), (5, f"{d} y {b}"), (6, d)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(None, 31, 0, sha(f"one {a}")), (None, 31, 30, sha("two")), (None, 30, 0, sha(b)), (None, 1, 0, sha("short")), (None, 0, 0, sha("")), (-(1 << 63), 31, 30, sha("least")), (3, 30, 0, sha(c)), (5, 31, 30, sha("x")), *[(5, 61, 30, sha(f"{d} y"))] * 2, (6, 30, 30, sha(""))]
    found = [tuple(r.values()) for r in got(substrings.removals(frame))]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    lost = [("two ", None), ("least ", -(1 << 63)), ("x ", 5), (f"{d} y ", 5), ("", 6)]
    assert sorted(((r["text"], r["doc_id"]) for r in got(substrings.without_repeats(frame))), key=repr) == sorted(lost, key=repr)


def brute_components(table, n, percent):
    sets = {}
    for i, text in table:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    order = sorted(sets)
    for a in order:
        for b in order:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, none, n):
    want = brute_components({i: t for i, t, *_ in rows() if i is not None}.items(), n, 80)
    found = got(minhash.near_duplicates(docs, words=n))
    assert len(found) == len(rows())
    for r in found:
        if r["doc_id"] is None:
            assert (r["component_id"], r["kept"]) == (None, True)
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert minhash.near_duplicates(none, words=n).count() == 0


def test_links_between_members_that_miss_the_centre(spark):
    """A large family of which many members aren't like its hub but like each other: blocks must find these links."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    table, k = [], 0
    for _family in range(12):
        start = list(base)
        for i in rng.sample(range(100), 8):
            start[i] = f"f{_family}_{i}"
        for _ in range(6):
            w = list(start)
            for i in rng.sample(range(100), rng.choice([1, 2, 3])):
                w[i] = f"n{k}_{i}"
            table.append((k, " ".join(w)))
            k += 1
    want = brute_components(table, 2, 80)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got(minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), words=2))}
    assert found == want


def test_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)] + [(2000, 2001 + i) for i in range(200)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    found = {r["node"]: r["label"] for r in got(components(spark.createDataFrame(edges, "a long, b long")))}
    assert all(label[k] == v for k, v in found.items())
    assert {k for k in label if label[k] != k} <= set(found)


def test_quality(spark, docs, none, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = quality.fit(table, quality.ratings_of(labels), 3)
    scored = quality.score(table, model, ["doc_id"])
    assert scored.count() == table.count()
    kept = quality.select(table, model)
    assert kept.columns == table.columns
    good = [r[0] for r in labels.where("quality = 1 and toxic = 0").select("doc_id").collect()]
    assert kept.where(F.col("doc_id").isin(good)).count() >= 0.95 * len(good)
    assert quality.fit(table, quality.ratings_of(labels.limit(0)), 3) is None
    assert quality.select(docs, None).count() == len(rows())
    assert quality.select(docs, model).columns == docs.columns
    assert quality.score(none, model, ["doc_id"]).count() == 0
    mixed = labels.select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("quality")).alias("quality"), "toxic").unionByName(labels)
    assert quality.fit(table, quality.ratings_of(mixed), 3) is not None


def test_language(spark, docs, none, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.fit(table.where(~held))
    found = langid.identify(table.where(held), model, ["doc_id", "lang"])
    n = found.count()
    assert found.where("lang = lang_pred").count() >= 0.97 * n
    assert found.where("score < 0 or score > 1").count() == 0
    odd = {r["doc_id"]: r for r in got(langid.identify(docs, model, ["doc_id"]))}
    assert (odd[0]["lang_pred"], odd[0]["score"], odd[2]["lang_pred"]) == ("und", 0.0, "und")
    assert langid.identify(none, model, ["doc_id"]).count() == 0
    untrained = langid.fit(none)
    assert {r["lang_pred"] for r in got(langid.identify(docs, untrained, ["doc_id"]))} == {"und"}


def test_queries_and_pipeline(spark, data):
    import corpus_pipeline
    from textloom.llm.queries import QUERIES

    n = spark.read.parquet(f"{data}/documents.parquet").count()
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 11))
    assert QUERIES["op10_kneser_ney_langid"](spark, data).count() == n
    docs_ = spark.read.parquet(f"{data}/documents.parquet")
    here = docs_
    to = spark.conf.get("spark.checkpoint.dir")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    before = n
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, here, data).write.parquet(f"{to}/stages/{os.getpid()}/{k}")
        here = spark.read.parquet(f"{to}/stages/{os.getpid()}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert here.columns == docs_.columns
            assert 0 < here.count() <= before
            assert here.where("n_chars <> length(text)").count() == 0
            before = here.count()
    assert here.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 1024
    assert here.select("doc_id").distinct().count() == before
