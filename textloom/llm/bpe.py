"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A batch of pre-tokens lies in one array of symbols, chained by `prev`/`next`
and cut between pre-tokens. Each merge rank has a bucket of positions whose
pair with their right neighbour has that rank; a three-level bitmap of 64-bit
words tells which buckets hold something, so the next rank is found by three
find-first-set steps. A popped bucket is merged at once, leftmost first where
positions overlap; positions whose pair has changed since are stale and are
skipped. The work is O(symbols) plus sorting, also for a pre-token of millions
of bytes.

Defined cases: a null or empty text has no ids; texts repeat freely; only the
id and text columns are read, so extra columns can't clash; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textloom.llm.common import ship, slices, two

#: Texts are taken through in parts of about so many bytes, and a longer text in parts of so many pre-tokens.
PART_BYTES, PART_TOKENS = 4 << 20, 1 << 20
#: A worker remembers so many short pre-tokens; the memory is emptied when full.
CACHE, CACHE_LEN = 400_000, 48
#: Buckets up to this size are merged position by position.
SMALL = 8


class RankQueue:
    """Buckets by rank under a 64-ary bitmap of three levels: push, and pop the lowest rank's bucket."""

    def __init__(self) -> None:
        self.low, self.mid, self.top = [0] * 4096, [0] * 64, 0
        self.bucket: dict[int, list] = {}

    def push(self, rank: int, positions) -> None:
        held = self.bucket.get(rank)
        if held is not None:
            held.append(positions)
            return
        self.bucket[rank] = [positions]
        i, j = rank >> 6, rank >> 12
        self.low[i] |= 1 << (rank & 63)
        self.mid[j] |= 1 << (i & 63)
        self.top |= 1 << j

    def pop(self) -> tuple[int, list] | None:
        if not self.top:
            return None
        j = (self.top & -self.top).bit_length() - 1
        word = self.mid[j]
        i = (j << 6) | ((word & -word).bit_length() - 1)
        word = self.low[i]
        rank = (i << 6) | ((word & -word).bit_length() - 1)
        word &= word - 1
        self.low[i] = word
        if not word:
            self.mid[j] &= ~(1 << (i & 63))
            if not self.mid[j]:
                self.top &= ~(1 << j)
        return rank, self.bucket.pop(rank)


class Bpe:
    """Encoder and decoder for a file of ranks (base64 token, rank), fewer than 2^18 of them."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.ranks = ranks
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        assert len(self.vocab) < 1 << 18
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[(a << 18) | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.cache: dict[str, bytes] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 18) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token as little-endian 32-bit integers, all in one queue."""
        out: list[bytes | None] = [None] * len(pieces)
        todo = []
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif not piece:
                out[i] = b""
            else:
                todo.append(i)
        if todo:
            lens = np.array([len(pieces[i]) for i in todo], np.int64)
            ends = np.cumsum(lens)
            starts = ends - lens
            tok, alive, odd = self._merge(np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8), starts, ends)
            counts = np.add.reduceat(alive.astype(np.int64), starts)
            ids = tok[alive].astype("<u4").tobytes()
            at = 0
            for i, n in zip(todo, (counts * 4).tolist(), strict=True):
                out[i] = ids[at : at + n]
                at += n
            for k in odd:
                out[todo[k]] = self._one(pieces[todo[k]])
        return out  # type: ignore[return-value]

    def _merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        n = len(data)
        tok = np.append(self.byte[data], -1)
        nxt = np.arange(1, n + 2)  # n stands for "none"
        nxt[ends - 1] = n
        prv = np.arange(-1, n)
        prv[starts] = n
        prv = np.append(prv, n)
        alive = np.ones(n + 1, bool)
        queue, odd = RankQueue(), set()
        left = np.flatnonzero(nxt[:n] < n)
        self._push(queue, left, self._rank(tok[left], tok[nxt[left]]), -1, odd, starts)
        pairs = self.pairs
        while popped := queue.pop():
            rank, parts = popped
            total = sum(1 if isinstance(p, int) else len(p) for p in parts)
            if total <= SMALL:
                spots = sorted({x for p in parts for x in ((p,) if isinstance(p, int) else p.tolist())})
                for p in spots:
                    q = nxt.item(p)
                    if q >= n or not alive.item(p) or pairs.get((tok.item(p) << 18) | tok.item(q)) != rank:
                        continue
                    tok[p] = rank
                    alive[q] = False
                    r = nxt.item(q)
                    nxt[p] = r
                    if r < n:
                        prv[r] = p
                        got = pairs.get((rank << 18) | tok.item(r))
                        if got is not None:
                            queue.push(got, p)
                            if got < rank:
                                odd.add(int(np.searchsorted(starts, p, "right")) - 1)
                    l = prv.item(p)
                    if l < n:
                        got = pairs.get((tok.item(l) << 18) | rank)
                        if got is not None:
                            queue.push(got, l)
                            if got < rank:
                                odd.add(int(np.searchsorted(starts, p, "right")) - 1)
                continue
            spots = np.unique(np.concatenate([np.atleast_1d(np.asarray(p, np.int64)) for p in parts]))
            spots = spots[alive[spots]]
            right = nxt[spots]
            fresh = right < n
            spots, right = spots[fresh], right[fresh]
            fresh = self._rank(tok[spots], tok[right]) == rank
            spots, right = spots[fresh], right[fresh]
            if not len(spots):
                continue
            # of overlapping positions every other one, from the left
            chained = np.append(False, right[:-1] == spots[1:])
            first = np.flatnonzero(~chained)
            keep = (np.arange(len(spots)) - np.repeat(first, np.diff(np.append(first, len(spots))))) % 2 == 0
            spots, right = spots[keep], right[keep]
            tok[spots] = rank
            alive[right] = False
            after = nxt[right]
            nxt[spots] = after
            prv[after] = spots
            prv[n] = n
            before = prv[spots]
            some = after < n
            self._push(queue, spots[some], self._rank(tok[spots[some]], tok[after[some]]), rank, odd, starts)
            some = before < n
            self._push(queue, before[some], self._rank(tok[before[some]], tok[spots[some]]), rank, odd, starts)
        return tok[:n], alive[:n], sorted(odd)

    @staticmethod
    def _push(queue: RankQueue, spots: np.ndarray, ranks: np.ndarray, now: int, odd: set, starts: np.ndarray) -> None:
        """Deal positions to buckets. A rank below the one being merged is dealt too, but its pre-token is done again one merge at a time."""
        real = ranks >= 0
        spots, ranks = spots[real], ranks[real]
        if not len(spots):
            return
        low = ranks < now
        if low.any():
            odd.update((np.searchsorted(starts, spots[low], "right") - 1).tolist())
        order = np.argsort(ranks, kind="stable")
        spots, ranks = spots[order], ranks[order]
        edge = np.flatnonzero(np.diff(ranks)) + 1
        bounds = [0, *edge.tolist(), len(ranks)]
        for rank, a, b in zip(ranks[np.append(0, edge)].tolist(), bounds, bounds[1:], strict=False):
            queue.push(rank, spots[a:b])

    def _one(self, piece: bytes) -> bytes:
        """One pre-token, strictly one merge at a time: lowest rank, then leftmost."""
        import heapq

        tok = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        n = len(tok)
        nxt, prv, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        queue = RankQueue()

        def push(p: int) -> None:
            if p >= 0 and nxt[p] < n:
                rank = pairs.get((tok[p] << 18) | tok[nxt[p]])
                if rank is not None:
                    if rank in queue.bucket:
                        heapq.heappush(queue.bucket[rank], p)
                    else:
                        queue.push(rank, p)

        for p in range(n - 1):
            push(p)
        while popped := queue.pop():
            rank, spots = popped
            p = heapq.heappop(spots)
            if spots:
                queue.push(rank, spots[0])
                queue.bucket[rank] = spots
            q = nxt[p]
            if tok[p] < 0 or q >= n or pairs.get((tok[p] << 18) | tok[q]) != rank:
                continue
            tok[p], tok[q] = rank, -1
            nxt[p] = nxt[q]
            if nxt[p] < n:
                prv[nxt[p]] = p
            push(p)
            push(prv[p])
        return np.array([t for t in tok if t >= 0], "<u4").tobytes()

    def _known(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each word; afterwards all are in the returned dictionary."""
        cache = self.cache
        missing = [w for w in set(words) if w not in cache]
        if not missing:
            return cache
        ids = self.encode_pieces([w.encode() for w in missing])
        if len(cache) + len(missing) > CACHE:
            here = {w: cache[w] for w in words if w in cache}
            cache.clear()
        else:
            here = None
        fresh = dict(zip(missing, ids, strict=True))
        cache.update((w, x) for w, x in fresh.items() if len(w) <= CACHE_LEN)
        if here is None and len(cache) and all(len(w) <= CACHE_LEN for w in missing):
            return cache
        return (here if here is not None else {w: cache[w] for w in words if w in cache}) | fresh

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        found = self.pattern.findall
        if len(texts) == 1 and len(texts[0]) > PART_BYTES:
            return [b"".join(self._stream(texts[0]))]
        words = [found(x) for x in texts]
        known = self._known([w for ws in words for w in ws])
        get = known.__getitem__
        return [b"".join(map(get, ws)) for ws in words]

    def _stream(self, text: str) -> Iterator[bytes]:
        matches = self.pattern.finditer(text)
        while words := [m.group() for m in islice(matches, PART_TOKENS)]:
            yield b"".join(map(self._known(words).__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], Bpe] = {}


def load(path: str, pattern: str) -> Bpe:
    """One encoder, with what it remembers, per worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Bpe(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers), decoded (binary) of each row of docs."""
    return _map(docs, path, pattern, id_col, text_col, False)


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: like encode(), hashed where it was made so that ids needn't travel."""
    return _map(docs, path, pattern, id_col, text_col, True)


def _map(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, digests: bool) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for part in slices(batches, PART_BYTES):
            ids = bpe.encode_batch(part.column(1).to_pylist())
            texts = [bpe.decode(x) for x in ids]
            if digests:
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())], ["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids binary, decoded binary"
    return two(docs, id_col, text_col).mapInArrow(run, schema)
