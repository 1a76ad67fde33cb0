"""The operators' algorithms against brute force, without Spark."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from textloom.llm import bpe, chunking, jpeg, langid, minhash, packing, pii, quality, sharding, substrings, words  # noqa: E402


@pytest.fixture(scope="module")
def coder():
    return bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def ids(enc, text):
    return np.array(enc.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_bpe_equals_tiktoken(coder, reference, texts):
    got = coder.encode_batch(texts)
    assert got == [ids(reference, t) for t in texts]
    assert [coder.decode(x) for x in got] == [t.encode() for t in texts]


def test_bpe_long_pre_tokens(coder, reference):
    rng = random.Random(1)
    for text in ("a" * 30_000, "".join(rng.choice("abcdeth") for _ in range(30_000)), "é" * 5000 + "中文" * 3000, " " * 9000 + "x", "<|endoftext|> it's"):
        assert coder.encode_batch([text]) == [ids(reference, text)]
    piece = b"".join(rng.choice([b"th", b"e", b"re", b"aa"]) for _ in range(3000))
    assert coder._one(piece) == coder.encode_pieces([piece])[0]


def test_bpe_in_parts(coder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "PART_BYTES", 50)
    monkeypatch.setattr(bpe, "PART_TOKENS", 7)
    monkeypatch.setattr(bpe, "CACHE", 5)
    text = "Some words, and more of them; don't stop. " * 9
    assert coder.encode_batch([text]) == [ids(reference, text)]
    assert coder.encode_batch(["a b", "c d e f g h"]) == [ids(reference, "a b"), ids(reference, "c d e f g h")]


def test_all_code_points_split_alike():
    """The rank file in tiktoken and the JSON file in tokenizers give the same ids, over blocks of all code points."""
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = [c for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)} " for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    assert [x.ids for x in t.encode_batch(texts, add_special_tokens=False)] == [e.encode_ordinary(x) for x in texts]


def test_rank_queue():
    q = bpe.RankQueue()
    ranks = random.Random(2).sample(range(200_000), 500)
    for r in ranks:
        q.push(r, r)
    assert [q.pop()[0] for _ in ranks] == sorted(ranks)
    assert q.pop() is None


# --- chunks


def brute_cuts(data: bytes):
    out, at = [], 0
    h = [0] * len(data)
    x = 0
    for i, b in enumerate(data):
        x = ((x << 1) + int(chunking.GEAR[b])) & 0xFFFFFFFF
        h[i] = x
    while at < len(data):
        end = len(data)
        for p in range(at + chunking.LEAST, len(data) + 1):
            window = h[p - 1]
            size = p - at
            bits = chunking.STRICT_BITS if size < chunking.NORMAL else chunking.LOOSE_BITS
            if size == chunking.MOST or window >> (32 - bits) == 0 or (size == chunking.NORMAL and window >> (32 - chunking.STRICT_BITS) == 0):
                end = p
                break
        out.append(min(end, len(data)))
        at = out[-1]
    return out


def test_cuts_equal_brute_force():
    rng = random.Random(3)
    for n in (0, 1, 31, 32, 33, 500, 5000):
        data = bytes(rng.choice(b"abcdefgh \n") for _ in range(n))
        got, counts = chunking.cuts(np.frombuffer(data, np.uint8), np.array([0, n]))
        assert got.tolist() == brute_cuts(data)
        assert counts.tolist() == [len(got)]


def test_chunks_do_not_depend_on_neighbours():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abcdefgh ") for _ in range(n)) for n in (0, 10, 900, 40, 3000)]
    assert chunking._sets_of(texts) == [chunking._sets_of([t])[0] for t in texts]


def test_insertion_keeps_most_chunks():
    rng = random.Random(5)
    text = bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(20_000))
    a, b = chunking._sets_of([text, text[:7000] + b"something new" + text[7000:]])
    assert chunking.containment(a, b) > 0.9
    assert chunking.containment(a, a) == 1.0
    assert chunking.containment({}, {}) == 1.0
    assert chunking.containment({}, a) == 0.0


# --- packing


def best(lengths, capacity):
    """The least number of bins, by trying everything."""
    lengths = sorted(lengths, reverse=True)
    least = [len(lengths)]

    def go(i, bins):
        if len(bins) >= least[0]:
            return
        if i == len(lengths):
            least[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += lengths[i]
                go(i + 1, bins)
                bins[k] -= lengths[i]
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return least[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9))
def test_small_packings_are_best(lengths):
    values, counts = np.unique(np.array(lengths, int), return_counts=True)
    plan = packing.pack_histogram(values.tolist(), counts.tolist(), 30)
    used = sorted(x for p, m in plan for x in p * m)
    assert used == sorted(lengths)
    assert all(sum(p) <= 30 for p, _ in plan)
    assert sum(m for _, m in plan) == (best(lengths, 30) if lengths else 0)


def test_large_packing_is_near_its_bound():
    rng = np.random.default_rng(1)
    values, counts = np.unique(rng.integers(1, 1025, 50_000), return_counts=True)
    plan = packing.pack_histogram(values.tolist(), counts.tolist(), 1024)
    bound = packing.least_bins(values, counts, 1024)
    assert bound <= sum(m for _, m in plan) <= bound * 1.005


def test_placements_are_gapless():
    plan = [((5, 3, 3), 4), ((5, 5), 2), ((3,), 1)]
    p = packing.placements(plan)
    places = {}
    for length, n in ((5, 8), (3, 9)):
        for rank in range(n):
            at = np.searchsorted(p["length"] << 44 | p["start"], length << 44 | rank, "right") - 1
            k = rank - p["start"][at]
            places.setdefault(int(p["sequence"][at] + k // p["each"][at]), []).append((int(p["offset"][at] + k % p["each"][at] * length), length))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
    assert len(places) == 7


# --- shards


def test_matrix_margins():
    rows, shards = [5, 0, 100, 3, 17], [42, 42, 41]
    m = sharding.communication_matrix(rows, shards, 7)
    assert m.sum(1).tolist() == rows
    assert m.sum(0).tolist() == shards


def test_large_hypergeometric_has_its_mean_and_spread():
    rng = np.random.default_rng(2)
    good, bad, n = 2 * 10**9, 3 * 10**9, 10**6
    got = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(400)])
    sd = (n * 0.4 * 0.6) ** 0.5
    assert abs(got.mean() - n * 0.4) < 5 * sd / 20
    assert 0.85 * sd < got.std() < 1.15 * sd


# --- words, signatures


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\né  ", max_size=30), max_size=5), st.integers(1, 4))
def test_shingles_equal_brute_force(texts, n):
    raw = [t.encode() for t in texts]
    got = words.shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), n)
    seen = {}
    for t, s in zip(raw, got, strict=True):
        w = re.findall(rb"[^\x20\x09-\x0D]+", t.lower())
        want = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
        assert len(s) == len(want)
        key = s.tobytes()
        assert seen.setdefault(want, key) == key
    assert len(set(seen.values())) == len(seen)


def test_signatures_estimate_likeness():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 62, 800, np.uint64)
    a, b = (np.sort(np.concatenate((common, rng.integers(0, 1 << 62, 100, np.uint64)))) for _ in range(2))
    sig = minhash.signatures([a, b])
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.1
    small = minhash.signatures([a[:3], a[:3]])
    assert (small[0] == small[1]).all()
    assert (small < 1 << 40).all()


def test_alike():
    a = np.arange(100, dtype=np.uint64)
    assert minhash._alike(a, [a, a[:80], a[:79], a[50:]], 80).tolist() == [True, True, False, False]


def test_sliding_min():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1000, 200)
    for n in (1, 2, 5, 13):
        assert substrings.sliding_min(x, n)[: len(x) - n + 1].tolist() == [x[i : i + n].min() for i in range(len(x) - n + 1)]


# --- jpeg


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=2000), min_size=1, max_size=5))
def test_store_and_read_back(payloads):
    padded = [jpeg.padded(x) for x in payloads]
    files = jpeg.store(padded)
    back = [b"".join(t.tobytes() for t in ts) for ts in jpeg.thumbnails_of(files)]
    assert back == [p.tobytes() for p in padded]
    assert jpeg.store([padded[0]]) == files[:1]


def test_many_images_in_a_file():
    data = np.random.default_rng(5).integers(0, 256, 576 * 700, np.uint8)
    (file,) = jpeg.store([data])
    thumbs = jpeg.thumbnails_of([file])[0]
    assert len(thumbs) == 3
    assert b"".join(t.tobytes() for t in thumbs) == data.tobytes()


def _bits(values):
    out = "".join(f"{v:0{n}b}" for v, n in values)
    out += "1" * (-len(out) % 8)
    return bytes(int(out[i : i + 8], 2) for i in range(0, len(out), 8)).replace(b"\xff", b"\xff\0")


def test_ac_coefficients_and_subsampled_colour_are_passed_over():
    """A 16x16 image, three components, luminance 2x2, no restart markers, with runs of AC coefficients."""
    dc = [(c, 4) for c in range(12)]
    head = b"\xff\xd8\xff\xdb\0\x43\0" + bytes([16] + [1] * 63)
    head += b"\xff\xc0\0\x11\x08\0\x10\0\x10\x03\x01\x22\0\x02\x11\0\x03\x11\0"
    head += b"\xff\xc4" + (19 + 12).to_bytes(2, "big") + b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    symbols = bytes([0x00, 0xF0, 0x02, 0x31])
    head += b"\xff\xc4" + (19 + 4).to_bytes(2, "big") + b"\x10" + bytes([0, 0, 4] + [0] * 13) + symbols
    head += b"\xff\xda\0\x0c\x03\x01\0\x02\0\x03\0\0\x3f\0"
    diffs = [10, -3, 0, 7, 2, -1]  # four luminance blocks, two of colour
    out = []
    for d in diffs:
        c = abs(d).bit_length()
        out.append(dc[c])
        if c:
            out.append((d if d > 0 else d + (1 << c) - 1, c))
        out += [(2, 3), (3, 2), (1, 3), (3, 3), (1, 1), (0, 3)]  # size 2, a run of 16, run 3 size 1, end of block
    image = head + _bits(out) + b"\xff\xd9"
    (thumb,) = jpeg.thumbnails_of([image])[0]
    want = np.array([[10, 7], [7, 14]]) * 16 // 8 + 128
    assert thumb.tolist() == want.tolist()


@pytest.mark.parametrize("data", [b"GIF89a", b"\xff\xd8\xff\xc2\0\x04\0\0", b"\xff\xd8\xff"])
def test_other_files_are_refused(data):
    with pytest.raises(ValueError, match="."):
        jpeg.thumbnails_of([data])


# --- personal data

BRUTE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BRUTE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii._luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return sorted(out, key=lambda x: (x[1], x[0]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "-", "_", " ", "+", "1", "4111111111111111", "4111-1111 1111-1111", "255", "256", "0001", "(", ")", "é", "x@y.zz", "1.2.3.4"]), max_size=25).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_scans_are_linear():
    for text in ("1" * 300_000, "a." * 150_000, "@" * 100_000, "+1" + "(" * 300_000, "1." * 150_000, "a@" * 100_000, "A1" * 150_000):
        pii.loose_spans(text, pii.base_spans(text))


def test_weak_supervision_takes_secrets_and_leaves_prose():
    secret = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and 10.1.2.3 or a@b.com'
    keys, counts = np.unique([pii.pattern(secret, s) for s in pii.base_spans(secret) + pii.loose_spans(secret, pii.base_spans(secret))], return_counts=True)
    model = pii.train(keys.astype(np.int64), counts.astype(np.int64))
    assert pii.redact(secret, model) == 'token = "[SECRET]" and [IP] or [EMAIL]'
    assert pii.redact("nothing to see here", model) == "nothing to see here"
    assert pii.train(np.empty(0, np.int64), np.empty(0, np.int64)) == {}


# --- quality, language


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(6)
    rows, grades = [], []
    for _ in range(600):
        g = int(rng.integers(0, 3))
        rows.append(np.unique(np.concatenate(([10 + g], rng.integers(1000, 5000, 30)))).astype(np.int32))
        grades.append(g)
    model = quality.fit_ordinal(rows, np.array(grades), 3)
    tails = model.tails([np.array([10 + g]) for g in range(3)])
    assert (np.diff(model.thresholds) > 0).all()
    assert (tails.sum(1).round() == [0, 1, 2]).all()
    assert (tails[:, 0] >= tails[:, 1]).all()


def test_symbols():
    cps, offsets = langid.symbols(["A, b!", "", "x9y "])
    shown = ["".join(map(chr, cps[a:b])) for a, b in zip(offsets, offsets[1:], strict=False)]
    assert [x.rstrip() for x in shown] == [" a b", "", " x y"]
    assert [x[0] for x in shown] == [" ", " ", " "]
    assert all("  " not in x for x in shown)
    alone = [langid.symbols([t])[0].tolist() for t in ("A, b!", "", "x9y ")]
    assert [cps[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == alone


def test_kneser_ney_sums_to_one():
    text = " the cat sat on the mat and the rat ate the hat"
    cps = np.array([ord(c) for c in text])
    grams, counts = np.unique(np.stack([cps[i : len(cps) - 4 + i] for i in range(5)], 1), axis=0, return_counts=True)
    alphabet = np.unique(grams[:, -1])
    model = langid.kneser_ney(grams, counts, np.zeros(len(grams), np.int64), 1, len(alphabet) + 1)
    row = model.grams[0]
    one = np.array([np.exp(model.log_p[0][row.find(langid.keys(np.array([c]), np.array([0]), 1))[0], 0]) for c in alphabet])
    unseen = 1 / (len(alphabet) + 1)
    total = one.sum() + unseen * float(np.exp(model.log_back[0][0, 0]))
    assert abs(total - 1) < 1e-3


def test_sorted_hashes_find():
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2))
    table = langid.Sorted(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1)) == -1).all()
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"


def test_secrets_of_any_length_and_those_around_a_base_span():
    for token, want in (("eyJ" + "aB3d_" * 200, "[SECRET]"), ("key_aB3xYz4111111111111111QwErTy", "[SECRET][CARD][SECRET]"), ("4111111111111111QwErTyUiOp", "[CARD][SECRET]")):
        text = f"a {token} b"
        base = pii.base_spans(text)
        loose = pii.loose_spans(text, base)
        model = {pii.pattern(text, s): 1.0 for s in loose}
        assert pii.redact(text, model) == f"a {want} b"
        spans = pii.chosen([{"kind": s[0], "start": s[1], "stop": s[2], "pattern": pii.pattern(text, s)} for s in base + loose], model)
        assert "".join(text[a:b] for _, a, b in spans) == token
    assert pii.loose_spans("ann_b3_c4_d5_long_name@example.com", pii.base_spans("ann_b3_c4_d5_long_name@example.com")) == []
