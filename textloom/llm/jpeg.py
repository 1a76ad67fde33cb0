"""Media columns: baseline JPEG, parsed, Huffman-decoded and reduced to DC-only luminance thumbnails in numpy.

The decoder reads baseline sequential JPEG (8-bit, Huffman, one to four
components, any sampling, with or without restart markers): it parses the
markers, takes the entropy-coded segments between restart markers, and walks
all of them in lockstep over whole arrays, each segment with its own bit
position; many images of equal headers are walked together. AC coefficients
are decoded only to be passed over. A block's mean luminance is its DC
coefficient times the quantiser over 8, plus 128; these means are the
thumbnail, at an eighth of the size.

`store` puts any bytes losslessly into such images, one byte as the DC
coefficient of one 8x8 block with quantiser 8, so that the thumbnail holds the
bytes exactly. Its Huffman table gives category c a code of 9 - c bits, so a
block always takes 10 bits and the encoder needs no bit loop; a restart marker
follows each row of 24 blocks. An image holds up to 341 x 576 bytes; more bytes
make more images one after the other.

Defined cases: a null text is empty and stored as 576 filler bytes; equal bytes
give equal files; anything that isn't baseline JPEG raises ValueError, which
`thumbnails` turns into a null row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import ship, slices, two

UNIT, FILLER = 576, 255
#: Blocks in a row of a stored image, and the most units of 576 bytes in one image.
ROW, MOST_UNITS = 24, 341
PART_BYTES = 2 << 20

ZIGZAG_DC_ONLY = np.uint8([8] + [1] * 63)


def _header(units: int) -> bytes:
    """Everything before the scan of a stored image."""
    h = struct.pack(">HH", 8 * UNIT // ROW * units, 8 * ROW)
    return b"".join(
        (
            b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00",
            b"\xff\xdb\x00\x43\x00" + ZIGZAG_DC_ONLY.tobytes(),
            b"\xff\xc0\x00\x0b\x08" + h + b"\x01\x01\x11\x00",
            # DC: category c has length 9 - c; AC: end of block alone
            b"\xff\xc4\x00\x1c\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)),
            b"\xff\xc4\x00\x14\x10" + bytes([1] + [0] * 15) + b"\x00",
            b"\xff\xdd\x00\x04" + struct.pack(">H", ROW),
            b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00",
        )
    )


def _block_codes() -> np.ndarray:
    """The 10 bits of each DC difference from -255 to 255: code, difference bits, end of block."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        length = 9 - c
        code = (1 << length) - 2  # one code of each length: 0, 10, 110, ...
        bits = d if d >= 0 else d + (1 << c) - 1
        out[d + 255] = ((code << c) | bits) << 1
    return out


_CODES = _block_codes()


def store(payloads: list[np.ndarray]) -> list[bytes]:
    """Each payload (uint8, a positive multiple of 576 long) as its stored file."""
    data = np.concatenate(payloads)
    rows = data.reshape(-1, ROW).astype(np.int64) - 128
    code = _CODES[np.diff(rows, axis=1, prepend=0) + 255]
    four = code.reshape(-1, 4)
    word = (four[:, 0] << 30) | (four[:, 1] << 20) | (four[:, 2] << 10) | four[:, 3]
    packed = np.ascontiguousarray(word.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 3:].reshape(-1, ROW * 10 // 8)
    # stuff a zero after each 0xFF of the coded bytes, and put a marker after each row
    n, width = packed.shape
    size = 1 + (packed == 255)
    out_len = size.sum(1) + 2
    ends = np.cumsum(out_len)
    out = np.zeros(int(ends[-1]), np.uint8)
    at = np.cumsum(size, axis=1) - size + (ends - out_len)[:, None]
    out[at.ravel()] = packed.ravel()
    out[ends - 2] = 255
    files, row = [], 0
    raw = out  # markers are numbered from each image's start
    for p in payloads:
        parts, left = [], len(p) // UNIT
        while left:
            units = min(left, MOST_UNITS)
            k = units * UNIT // ROW
            raw[ends[row : row + k] - 1] = 0xD0 + np.arange(k) % 8
            raw[ends[row + k - 1] - 1] = 0xD9  # after the last row the image ends
            a = ends[row] - out_len[row]
            parts += [_header(units), raw[a : ends[row + k - 1]].tobytes()]
            row, left = row + k, left - units
        files.append(b"".join(parts))
    return files


class Image:
    """Parsed headers of one image, and where its scan lies."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.quant: dict[int, np.ndarray] = {}
        self.huff: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.restart = 0
        self.components: list[list[int]] = []
        start, at = at, at + 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if len(data) < at + 4 or data[at] != 255:
                raise ValueError("marker expected")
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    counts, n = body[1:17], sum(body[1:17])
                    self.huff[body[0]] = _lookup(counts, body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0 or marker == 0xC1:
                if body[0] != 8:
                    raise ValueError("not 8 bits a sample")
                self.height, self.width = struct.unpack_from(">HH", body, 1)
                self.components = [[body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2], 0] for i in range(6, 6 + 3 * body[5], 3)]
            elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not baseline")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xDA:
                if body[0] != len(self.components) or not self.components:
                    raise ValueError("scans of single components aren't read")
                for i in range(1, 1 + 2 * body[0], 2):
                    next(c for c in self.components if c[0] == body[i])[4] = body[i + 1]
                break
        self.head, self.scan = data[start:at], at
        if len(self.components) == 1:
            self.components[0][1] = self.components[0][2] = 1
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        self.across, self.down = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        self.mcus = self.across * self.down

    def segments(self, data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """The scan's bytes without stuffing, where each restart segment starts in them, and where the image ends."""
        raw = np.frombuffer(data, np.uint8, offset=self.scan)
        mark = np.flatnonzero(raw[:-1] == 255)
        follow = raw[mark + 1]
        stop = mark[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7)) & (follow != 255)]
        end = int(stop[0]) if len(stop) else len(raw)
        mark, follow = mark[mark < end], follow[: int((mark < end).sum())]
        drop = np.ones(end, bool)
        drop[mark[follow == 0] + 1] = False
        cutoff = mark[(follow >= 0xD0) & (follow <= 0xD7)]
        drop[cutoff] = drop[cutoff + 1] = False
        starts = np.append(0, np.cumsum(drop)[cutoff]) if len(cutoff) else np.zeros(1, np.int64)
        return raw[:end][drop], starts, self.scan + end + 2


def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol for each 16-bit beginning; length 0 where no code begins so."""
    if (held := _HUFFMAN.get(counts + symbols)) is not None:
        return held
    if len(_HUFFMAN) > 64:
        _HUFFMAN.clear()
    lens, syms = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = k = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            a = code << (16 - length)
            lens[a : a + (1 << (16 - length))] = length
            syms[a : a + (1 << (16 - length))] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    _HUFFMAN[counts + symbols] = lens, syms
    return lens, syms


_HUFFMAN: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def decode_dc(images: list[tuple[Image, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The luminance DC coefficients (blocks down, blocks across) of images with equal tables and restart interval.

    Segments of all images advance together, one block at a time.
    """
    first = images[0][0]
    per = first.restart or max(im.mcus for im, _, _ in images)
    base, starts, blocks = 0, [], []
    for im, raw, seg in images:
        want = -(-im.mcus // first.restart) if first.restart else 1
        if len(seg) < want:
            raise ValueError("restart markers are missing")
        starts.append((seg[:want] + base) * 8)
        n = np.full(want, per, np.int64)
        n[-1] = im.mcus - per * (want - 1)
        blocks.append(n)
        base += len(raw)
    data = np.concatenate([raw for _, raw, _ in images] + [np.zeros(8, np.uint8)]).astype(np.uint32)
    words = (data[:-4] << 24) | (data[1:-3] << 16) | (data[2:-2] << 8) | data[3:-1]  # 32 bits from each byte on
    last = len(words) - 1
    pos, todo = np.concatenate(starts), np.concatenate(blocks)

    def bits(at: np.ndarray, n: int) -> np.ndarray:
        return ((words[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - n)).astype(np.int64)

    luma = first.components[0]
    each = luma[1] * luma[2]
    out = np.zeros((len(pos), per * each), np.int64)
    pred = np.zeros((len(first.components), len(pos)), np.int64)
    even = bool((todo == todo[0]).all())
    for m in range(int(todo.max())):
        live = None if even else np.flatnonzero(todo > m)
        at = pos if live is None else pos[live]
        for c, (_, h, v, _, table) in enumerate(first.components):
            dc_len, dc_sym = first.huff[table >> 4]
            ac_len, ac_sym = first.huff[0x10 | (table & 15)]
            for b in range(h * v):
                head = bits(at, 16)
                n = dc_len[head]
                if not n.all():
                    raise ValueError("no such code")
                size = dc_sym[head]
                at = at + n
                value = bits(at, 16) >> (16 - size)
                at = at + size
                diff = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
                if live is None:
                    pred[c] += diff
                else:
                    pred[c, live] += diff
                if c == 0:
                    if live is None:
                        out[:, m * each + b] = pred[0]
                    else:
                        out[live, m * each + b] = pred[0, live]
                # pass over the AC coefficients
                head = bits(at, 16)
                n, sym = ac_len[head], ac_sym[head]
                at = at + n
                if sym.any() or not n.all():
                    k = np.ones(len(at), np.int64)
                    going = np.flatnonzero(sym != 0)
                    while len(going):
                        if not n[going].all():
                            raise ValueError("no such code")
                        s = sym[going]
                        at[going] += s & 15
                        k[going] += (s >> 4) + 1
                        going = going[k[going] < 64]
                        head = bits(at[going], 16)
                        n[going], sym[going] = ac_len[head], ac_sym[head]
                        at[going] += n[going]
                        going = going[sym[going] != 0]
        if live is None:
            pos = at
        else:
            pos[live] = at
    result, row = [], 0
    for (im, _, _), n in zip(images, blocks, strict=True):
        flat = out[row : row + len(n)].reshape(-1)[: im.mcus * each]
        row += len(n)
        grid = flat.reshape(im.down, im.across, luma[2], luma[1]).transpose(0, 2, 1, 3)
        result.append(grid.reshape(im.down * luma[2], im.across * luma[1]))
    return result


def thumbnails_of(files: list[bytes]) -> list[list[np.ndarray]]:
    """For each file its images' DC-only luminance thumbnails (uint8)."""
    jobs: list[tuple[int, Image, np.ndarray, np.ndarray]] = []
    for i, data in enumerate(files):
        at = 0
        while at < len(data):
            im = Image(data, at)
            raw, seg, at = im.segments(data)
            jobs.append((i, im, raw, seg))
    groups: dict[tuple, list[int]] = {}
    for k, (_, im, _, _) in enumerate(jobs):
        groups.setdefault(_signature(im), []).append(k)
    found: list[np.ndarray] = [np.empty(0)] * len(jobs)
    for own in groups.values():
        for k, dc in zip(own, decode_dc([jobs[k][1:] for k in own]), strict=True):
            im = jobs[k][1]
            q = int(im.quant[im.components[0][3]][0])
            found[k] = np.clip((dc * q + 4) // 8 + 128, 0, 255).astype(np.uint8)
    out: list[list[np.ndarray]] = [[] for _ in files]
    for (i, im, _, _), t in zip(jobs, found, strict=True):
        out[i].append(t[: -(-im.height // 8), : -(-im.width // 8)])
    return out


def _signature(im: Image) -> tuple:
    """Equal for images that can be decoded together: the header without the dimensions."""
    at = im.head.find(b"\xff\xc0")
    return (im.head[: at + 5] + im.head[at + 9 :], 0 if im.restart else im.mcus)


def image_hash(thumb: np.ndarray) -> str:
    """Average hash over 8x8 means of a thumbnail, as 16 hex digits."""
    h, w = thumb.shape
    rows, cols = np.arange(9) * h // 8, np.arange(9) * w // 8
    sums = np.zeros((h + 1, w + 1))
    sums[1:, 1:] = thumb.cumsum(0, dtype=np.int64).cumsum(1)
    lo_r, hi_r = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1)
    lo_c, hi_c = cols[:-1], np.maximum(cols[1:], cols[:-1] + 1)
    hi_r, hi_c = np.minimum(hi_r, h), np.minimum(hi_c, w)
    box = sums[np.ix_(hi_r, hi_c)] - sums[np.ix_(lo_r, hi_c)] - sums[np.ix_(hi_r, lo_c)] + sums[np.ix_(lo_r, lo_c)]
    mean = box / ((hi_r - lo_r)[:, None] * (hi_c - lo_c)[None, :])
    return np.packbits(mean > mean.mean()).tobytes().hex()


def feature(thumbs: list[np.ndarray]) -> str:
    """Dimensions and thumbnail hash of each image, comma-joined."""
    return ",".join(f"{8 * t.shape[1]}x{8 * t.shape[0]}:{image_hash(t)}" for t in thumbs)


def padded(text: bytes) -> np.ndarray:
    """The bytes and fillers up to a positive multiple of 576."""
    n = len(text)
    return np.frombuffer(text + bytes([FILLER]) * (-n % UNIT if n else UNIT), np.uint8)


def thumbnails(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, width, height, thumbnail (binary), feature of the first image in each row's media; nulls where it isn't baseline JPEG."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    t = thumbnails_of([data])[0]
                    out.append((key, 8 * t[0].shape[1], 8 * t[0].shape[0], t[0].tobytes(), feature(t)))
                except (ValueError, TypeError, KeyError, IndexError, struct.error, StopIteration):
                    out.append((key, None, None, None, None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)], ["id", "width", "height", "thumbnail", "feature"])

    return media.select(media[id_col].cast("long").alias("id"), media[media_col].alias("media")).mapInArrow(run, "id long, width int, height int, thumbnail binary, feature string")


def _columns(part: pa.RecordBatch, files: bool) -> pa.RecordBatch:
    texts = [x.encode() for x in part.column(1).to_pylist()]
    media = store([padded(x) for x in texts])
    thumbs = thumbnails_of(media)
    back = [b"".join([t.tobytes() for t in ts]) for ts in thumbs]
    shown = [feature(ts) for ts in thumbs]
    if files:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary()), pa.array(back, pa.binary()), pa.array(shown)], ["doc_id", "n_bytes", "media", "payload", "feature"])
    return pa.RecordBatch.from_arrays(
        [
            part.column(0),
            pa.array(list(map(len, texts)), pa.int64()),
            pa.array(list(map(len, back)), pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in back]),
            pa.array([zlib.crc32(x[-32:]) for x in back], pa.int64()),
            pa.array(list(map(len, media)), pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in media]),
            pa.array(shown),
        ],
        ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    )


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the stored file), payload (read back from it), feature of each row of docs."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES):
            yield _columns(part, True)

    return two(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def text_media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like text_media(), with lengths and checksums in place of the bytes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PART_BYTES):
            yield _columns(part, False)

    return two(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
