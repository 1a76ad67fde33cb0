"""Operators and their queries against plain versions that share no code with them."""

import collections
import functools
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402
from test_pure import BRUTE, brute_cuts, brute_spans  # noqa: E402

import corpus_pipeline  # noqa: E402
from textloom.llm import chunking, jpeg, langid, packing, pii, quality, sharding  # noqa: E402
from textloom.llm.queries import QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


def ids_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# --- op2


def plain_chunks(text):
    data, found, at = text.encode(), {}, 0
    for end in brute_cuts(data):
        found[data[at:end]] = end - at
        at = end
    return found


def plain_containment(a, b):
    return sum(n for c, n in a.items() if c in b) / sum(a.values()) if a else float(not b)


def test_likeness_of_the_query(spark):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(60)]
    base = " ".join(rng.choice(words) for _ in range(700))
    rows = [(1, base), (2, base[:1500] + " changed " + base[1500:]), (3, ""), (5, None), (8, "ñ" * 301), (9, base), (11, "short"), (12, base[900:]), (40, base * 3)]
    found = {r["doc_id"]: r for r in chunking.edited_likeness(ids_frame(spark, rows).repartition(3)).collect()}
    ordered = [(i, t or "") for i, t in rows]
    seen = {}
    for (i, x), (_, y) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        edited = x[: len(x) - len(x) // 2] + y[: len(x) // 2]
        own, new, after = plain_chunks(x), plain_chunks(edited), plain_chunks(y)
        r = found[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(plain_containment(own, new), abs=1e-12)
        assert r["near_next"] == pytest.approx(plain_containment(own, after), abs=1e-12)
        # a fingerprint is 20 hex digits for each distinct chunk, and tells the chunks apart as they are
        assert len(r["fingerprint"]) == 20 * len(own)
        assert len(r["edited_fingerprint"]) == 20 * len(new)
        for text, print_ in ((x, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            key = frozenset(plain_chunks(text))
            assert seen.setdefault(key, print_) == print_
    assert len(set(seen.values())) == len(seen)


def test_one_id_fills_many_buckets(spark):
    """A third of all rows without an id, and a hot id: they are dealt out, and each row still meets the next one."""
    import xxhash

    rng = random.Random(22)
    rows = [(None, f"none {rng.random()} " + "x" * (i % 50)) for i in range(400)] + [(7, f"seven {i}") for i in range(300)] + [(100 + i, f"text {i} " * (i % 9)) for i in range(500)]
    frame = ids_frame(spark, rows).repartition(5)
    dealt = chunking.in_order(frame, 24).groupBy("bucket").count().collect()
    assert max(r["count"] for r in dealt) <= 4 * 1200 / 24
    signed = lambda t: (h := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (h >> 63 << 64)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    want = collections.Counter()
    for (i, x), (_, y) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        want[i, hashlib.sha256((x[: len(x) - len(x) // 2] + y[: len(x) // 2]).encode()).hexdigest()] += 1
    found = chunking.edited_likeness(frame).collect()
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in found) == want


# --- op3


def all_undominated(room, counts):
    lengths, found = [x for x in range(1, room + 1) if counts[x]], set()

    def fill(i, left, parts):
        found.add(tuple(parts))
        for j in range(i, -1, -1):
            if lengths[j] <= left and parts.count(lengths[j]) < counts[lengths[j]]:
                fill(j, left - lengths[j], [*parts, lengths[j]])

    def holds(a, b, i=0):
        return i == len(b) or any(a[k] >= b[i] and holds((*a[:k], a[k] - b[i], *a[k + 1 :]), b, i + 1) for k in range(len(a)))

    fill(len(lengths) - 1, room, [])
    return {b for b in found if not any(a != b and holds(a, b) for a in found)}


def test_fillings_are_all_the_undominated_ones():
    rng = random.Random(1)
    for _ in range(120):
        room = rng.randrange(5, 25)
        counts = np.zeros(room + 1, np.int64)
        for _ in range(rng.randrange(1, 8)):
            counts[rng.randrange(1, room + 1)] += 1
        got = list(packing.fillings(room, counts))
        assert len(got) == len(set(got))
        assert set(got) == all_undominated(room, counts)
        assert [sum(p) for p in got] == sorted((sum(p) for p in got), reverse=True)


def fewest(items, capacity):
    """By all subsets: (bins, filling of the last one) is least for each subset of the items."""
    best = {0: (0, capacity)}
    for mask in range(1 << len(items)):
        bins, filled = best[mask]
        for i, x in enumerate(items):
            if not mask >> i & 1:
                new = (bins, filled + x) if filled + x <= capacity else (bins + 1, x)
                best[mask | 1 << i] = min(new, best.get(mask | 1 << i, new))
    return best[(1 << len(items)) - 1][0]


def test_search_finds_the_optimum():
    rng = random.Random(3)
    improved = 0
    for _ in range(60):
        capacity = rng.choice([20, 50, 100])
        items = [rng.randrange(max(1, capacity // 8), capacity * 3 // 4) for _ in range(11)]
        lengths, counts = np.unique(items, return_counts=True)
        want = fewest(items, capacity)
        assert sum(m for _, m in packing.pack_histogram(lengths.tolist(), counts.tolist(), capacity)) == want
        improved += sum(m for _, m in packing.best_fit_decreasing(lengths, counts, capacity)) > want
    assert improved  # the search does better than its first incumbent somewhere


def test_thirty_pieces_made_to_fit():
    rng = random.Random(4)
    for _ in range(20):
        items = []
        for _ in range(10):
            a, b = sorted(rng.sample(range(1, 100), 2))
            items += [a, b - a, 100 - b]
        lengths, counts = np.unique(items, return_counts=True)
        assert sum(m for _, m in packing.pack_histogram(lengths.tolist(), counts.tolist(), 100)) == 10


# --- op5


@pytest.fixture(scope="module")
def lopsided(spark, tmp_path_factory):
    """All rows in one of several partitions, as a file of one row group gives them."""
    to = f"{tmp_path_factory.mktemp('lopsided')}/rows"
    spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 40).alias("text")).coalesce(1).write.parquet(to)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    frame = spark.read.parquet(to)
    assert frame.rdd.getNumPartitions() > 2
    yield frame
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_full_partition_among_empty_ones(spark, lopsided):
    dealt = sharding.shard(sharding.document_rows(lopsided), 7, seed=2)
    rows = dealt.orderBy("shard", "slot").collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert [r["slot"] for r in rows if r["shard"] == s] == list(range(n))
    pieces = packing.pieces(lopsided, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 2, 1024)
    packed = packing.pack(pieces, 1024).orderBy("sequence_id", "offset").collect()
    assert len(packed) == pieces.count()
    at = collections.Counter()
    for r in packed:
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]


def test_matrix_lines_add_up_and_follow_the_law():
    rows, shards = [3, 0, 2, 4], [3, 3, 3]
    times, seen = 3000, collections.Counter()
    for seed in range(times):
        m = sharding.communication_matrix(rows, shards, seed)
        assert m.sum(0).tolist() == shards
        assert m.sum(1).tolist() == rows
        seen[tuple(map(tuple, m.tolist()))] += 1
    # P(matrix) = prod rows! prod shards! / (n! prod cells!)
    fact = math.factorial
    statistic = freedom = 0
    for m, n in seen.items():
        p = math.prod(map(fact, rows)) * math.prod(map(fact, shards)) / (fact(9) * math.prod(fact(c) for line in m for c in line))
        statistic += (n - times * p) ** 2 / (times * p)
        freedom += 1
    assert statistic < freedom + 5 * math.sqrt(2 * freedom)


def test_every_place_is_equally_likely(spark):
    """Over many seeds each row is in each (shard, slot) about equally often."""
    rows = spark.range(12, numPartitions=3).selectExpr("id as doc_id")
    seen = collections.Counter()
    for seed in range(40):
        for r in sharding.shard(rows, 3, seed=seed).collect():
            seen[r["doc_id"], r["shard"], r["slot"]] += 1
    assert sum(seen.values()) == 40 * 12
    want = 40 / 12
    statistic = sum((seen[i, s, k] - want) ** 2 / want for i in range(12) for s in range(3) for k in range(4))
    assert statistic < 121 + 5 * math.sqrt(2 * 121)


# --- op6


def plain_decode(data):
    """One-component baseline JPEG, bit by bit: the means of its blocks, row by row, image by image."""
    out, at = b"", 0
    while at < len(data):
        assert data[at : at + 2] == b"\xff\xd8"
        at += 2
        tables, quant, height, width, every = {}, 0, 0, 0, 0
        while True:
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                quant = body[1]
            elif marker == 0xC0:
                height, width = struct.unpack(">HH", body[1:5])
                assert body[5] == 1
            elif marker == 0xC4:
                code, k, codes = 0, 17, {}
                for length in range(1, 17):
                    for _ in range(body[length]):
                        codes[length, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0]] = codes
            elif marker == 0xDD:
                every = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                break
        scan, restarts = [], set()
        while True:  # unstuffed bits, and where restart markers were
            if data[at] != 0xFF:
                scan += [data[at] >> (7 - i) & 1 for i in range(8)]
                at += 1
            elif data[at + 1] == 0:
                scan += [1] * 8
                at += 2
            elif 0xD0 <= data[at + 1] <= 0xD7:
                restarts.add(len(scan))
                at += 2
            else:
                assert data[at : at + 2] == b"\xff\xd9"
                at += 2
                break
        spot = 0

        def bits(n):
            nonlocal spot
            value = int("".join(map(str, scan[spot : spot + n])) or "0", 2)
            spot += n
            return value

        def symbol(codes):
            nonlocal spot
            for length in range(1, 17):
                got = codes.get((length, int("".join(map(str, scan[spot : spot + length])), 2)))
                if got is not None:
                    spot += length
                    return got
            raise AssertionError

        dc = 0
        for block in range(height // 8 * (width // 8)):
            if every and block and block % every == 0:
                spot = min(r for r in restarts if r >= spot)
                dc = 0
            n = symbol(tables[0])
            value = bits(n)
            dc += value if not n or value >> (n - 1) else value - (1 << n) + 1
            k = 1
            while k < 64:
                rs = symbol(tables[16])
                if rs == 0:
                    break
                k += (rs >> 4) + 1
                bits(rs & 15)
            out += bytes([min(255, max(0, dc * quant // 8 + 128))])
    return out


def plain_hash(thumb):
    h, w = thumb.shape
    means = [[float(np.mean(thumb[h * i // 8 : max(h * (i + 1) // 8, h * i // 8 + 1), w * j // 8 : max(w * (j + 1) // 8, w * j // 8 + 1)])) for j in range(8)] for i in range(8)]
    whole = sum(map(sum, means)) / 64
    return f"{int(''.join('1' if x > whole else '0' for line in means for x in line), 2):016x}"


def test_media_of_the_query(spark):
    rng = random.Random(5)
    cases = [None, "", "a", "héllo " * 40, "x" * 576, "".join(chr(rng.randrange(32, 0x2000)) for _ in range(700)), "x" * 576]
    rows = list(enumerate(cases))
    files = {r["doc_id"]: r for r in jpeg.text_media(ids_frame(spark, rows)).collect()}
    for r in jpeg.text_media_digests(ids_frame(spark, rows)).collect():
        raw = (cases[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        media = bytes(files[r["doc_id"]]["media"])
        assert plain_decode(media) == payload
        thumb = np.frombuffer(payload, np.uint8).reshape(-1, 24)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert r["feature"] == f"192x{8 * len(thumb)}:{plain_hash(thumb)}"


# --- op7


def test_spans_of_the_query(spark, data, texts):
    for r in QUERIES["op7_weak_pii"](spark, data).collect():
        want = brute_spans(texts[r["doc_id"]])
        shown = [f"{list(BRUTE)[k]}:{a}:{b}" for k, a, b in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BRUTE] == [sum(s[0] == k for s in want) for k in range(4)]
        have = r["spans"].split(",") if r["spans"] else []
        assert [s for s in have if s.split(":")[0] in BRUTE] == shown
        assert have == sorted(have, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0]), int(s.split(":")[2])))


@pytest.mark.parametrize("n", [64, 65, 250, 5000])
def test_no_length_hides_personal_data(n):
    secret = ("aB3dE9gH1j" * n)[:n]
    text = f"token={secret} and {'ab' * n} [at] {'cd' * n}{' [dot] ef' * 12} end"
    spans = [(pii.KINDS[k], text[a:b]) for k, a, b in pii.loose_spans(text, [])]
    assert ("masked_email", text[text.index(" and ") + 5 : -4]) in spans
    assert any(kind == "secret" and secret in s for kind, s in spans)


# --- op9


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def test_gradients_by_the_likelihood_itself():
    """With every feature in every row the weights can't tell rows apart, and the thresholds must give the grades' shares."""
    rng = np.random.default_rng(8)
    grades = rng.choice(3, 9000, p=[0.2, 0.5, 0.3])
    model = quality.fit_ordinal([np.array([3, 4], np.int32)] * len(grades), grades, 3)
    tails = model.tails([np.array([3, 4])])[0]
    assert tails == pytest.approx([(grades >= 1).mean(), (grades >= 2).mean()], abs=0.03)
    assert (np.diff(model.thresholds) > 0).all()


def test_scores_of_the_query_and_held_out_accuracy(spark, data, texts):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, quality.ratings_of(labels), 3)
    for r in QUERIES["op9_ordinal_quality"](spark, data).limit(40).collect():
        raw = np.frombuffer(texts[r["doc_id"]].encode(), np.uint8)
        total = sum(float(model.weights[k]) for k in quality.features(raw, np.array([0, len(raw)]))[0])
        tails = [sigmoid(total - t) for t in model.thresholds.tolist()]
        assert r["tail_top"] == pytest.approx(tails[-1], abs=1e-4)
        assert r["expected_grade"] == pytest.approx(sum(tails), abs=2e-4)
        assert r["kept"] == (r["tail_top"] >= 0.5)
    # fitted on some of the rated documents, tried on the others
    big = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = quality.fit(docs, quality.ratings_of(labels.where(~test)), 3)
    scored = quality.score(docs, model, ["doc_id"]).join(quality.ratings_of(labels.where(test)), "doc_id")
    right = scored.where((F.col("tail_top") >= 0.5) == (F.col("grade") == 2)).count()
    assert right >= 0.9 * scored.count()


# --- op10


def plain_letters(text):
    return " " + re.sub("[^\\w]|[\\d_]", " ", text.lower())


def plain_model(learned, alphabet):
    """Interpolated Kneser-Ney by dictionaries: p(character | up to four before it), and each order's discount."""
    runs = [collections.Counter()]
    for text in learned:
        runs[0].update(text[i : i + 5] for i in range(len(text) - 4))
    for _ in range(4):
        runs.append(collections.Counter(g[1:] for g in runs[-1]))
    runs.reverse()
    discounts = []
    for counts in runs:
        n1, n2 = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        discounts.append(min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 + n2 else 0.5)))
    followers = []
    for counts in runs:
        per = collections.defaultdict(list)
        for g, c in counts.items():
            per[g[:-1]].append(c)
        followers.append(per)

    @functools.cache
    def p(context, c):
        n = len(context)
        below = p(context[1:], c) if n else 1 / alphabet
        seen = followers[n].get(context)
        if not seen:
            return below
        return max(runs[n][context + c] - discounts[n], 0) / sum(seen) * (runs[n][context + c] > 0) + discounts[n] * len(seen) / sum(seen) * below

    return p, discounts


def test_kneser_ney_by_dictionaries(spark):
    """Fifty languages, in several blocks: discounts and cross-entropies equal plain models."""
    rng = random.Random(6)
    texts = {}
    for k in range(50):
        stock = ["".join(rng.choice("abcdefghijklmno"[k % 5 : k % 5 + 9]) for _ in range(rng.randrange(2, 6))) for _ in range(30)]
        texts[f"l{k:02}"] = [" ".join(rng.choice(stock) for _ in range(rng.randrange(3, 40))) for _ in range(rng.randrange(1, 9))]
    texts["l07"] = [texts["l07"][0]]  # a language of one text is learned
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    frame = spark.createDataFrame([*rows, *rows[:20], (None, "abc abc abc", None), (None, None, "l01")], "doc_id long, text string, lang string")
    model = langid.fit(frame)
    assert model.languages == sorted(texts)
    assert len(model.blocks) == 7
    sample = langid._sample(frame, langid.MAX_ROWS, "text", "lang").collect()
    assert sorted((r["lang"], r["text"]) for r in sample) == sorted({(lang, t) for _, t, lang in rows})
    learned = collections.defaultdict(list)
    for r in sample:
        if r["rank"] % langid.CALIBRATE:
            learned[r["lang"]].append(plain_letters(r["text"]))
    alphabet = len({c for ts in learned.values() for t in ts for c in t[4:]}) + 1
    tried = [t for _, t, _ in rows[::17]] + ["xyz unseen letters", "a"]
    h, _ = model.entropies(tried)
    for k, lang in enumerate(model.languages):
        p, discounts = plain_model(learned[lang], alphabet)
        block = model.blocks[k // langid.BLOCK]
        assert [float(d[k % langid.BLOCK]) for d in block.discounts] == pytest.approx(discounts)
        for i, text in enumerate(tried):
            x = plain_letters(text)
            want = -sum(math.log(p(x[max(0, j - 4) : j], x[j])) for j in range(1, len(x))) / (len(x) - 1)
            assert h[i, k] == pytest.approx(want, abs=2e-5)


def test_sample_is_bounded_by_texts_of_a_language(spark):
    many = spark.range(400).selectExpr("cast(null as long) as doc_id", "if(id < 200, 'the same text again', concat('text number ', id)) as text", "'x' as lang")
    rows = langid._sample(many, 50, "text", "lang").collect()
    assert 0 < len(rows) <= 50
    assert len({r["text"] for r in rows}) == len(rows)
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))


# --- the pipeline's near-dedup


def test_near_dedup_keeps_unlike_texts_of_an_id_and_one_of_each_class(spark, data):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "p"), (1, a, "p"), (2, a, "q"), (5, b, "r"), (5, c, "s"), (6, c, "t"), (None, b + " z", "u"), (None, "alone without an id here", "v"), (None, None, "w"), (7, "", "x"), (8, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key string")
    found = corpus_pipeline.near_dedup(spark, docs, data)
    assert found.columns == docs.columns
    kept = sorted(map(tuple, found.collect()), key=repr)
    # of the class of b one stays (that of id 5 or the one without id), of the class of c the row of id 6
    always = [(1, a, "p"), (6, c, "t"), (None, "alone without an id here", "v"), (None, None, "w"), (7, "", "x"), (8, "", "y")]
    assert len(kept) == len(always) + 1
    assert all(r in kept for r in always)
    assert (5, b, "r") in kept or (None, b + " z", "u") in kept
