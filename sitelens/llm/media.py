"""Baseline JPEG media columns.

``encode`` stores bytes losslessly as the quantised coefficients of a grey baseline JPEG, 64 a
block: byte b is the coefficient b - 128, DC coefficients as differences from the block before, AC
coefficients as runs of zeros and sizes, both by Huffman tables of many symbols, with a restart
marker after every ``RESTART`` blocks. ``decode`` reads any baseline JPEG: it parses the markers, Huffman
decodes every scan by the tables found there, and rebuilds the luminance thumbnail of the DC
coefficients alone. Restart intervals, of many images together, are decoded side by side, a
symbol of each at a time.

A null text counts as empty. Texts of any length are stored whole: wider images hold them, and a
comment segment names the payload's length. Repeated rows give equal values. An empty table gives
no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import table

UNIT, BLOCK, RESTART, MIDDLE = 192, 64, 8, 128
#: Bytes of texts whose images are decoded side by side; a longer text is taken alone.
TOGETHER = 2_000_000
_SIZE = np.array([k.bit_length() for k in range(2048)])
_ZEROS, _END = 0xF0, 0x00


def payload_of(raw: bytes, unit: int = UNIT) -> bytes:
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b" ")


class Huffman:
    """A table: symbols by code length, the codes that follow from it, and its look-up by 16 bits."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.counts, self.symbols = counts, symbols
        self.code, self.length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
        self.found = np.zeros(1 << 16, np.uint8)
        self.used = np.zeros(1 << 16, np.uint8)
        code = at = 0
        for length, n in enumerate(counts, 1):
            for symbol in symbols[at : at + n]:
                self.code[symbol], self.length[symbol] = code, length
                first = code << (16 - length)
                self.found[first : first + (1 << (16 - length))] = symbol
                self.used[first : first + (1 << (16 - length))] = length
                code += 1
            at += n
            code <<= 1

    @classmethod
    def ranked(cls, symbols: list[int], steps: list[tuple[int, int]]) -> Huffman:
        """The first symbols of a ranking get the shorter codes; ``steps`` are (how many, length)."""
        counts, length = [0] * 16, 0
        left = len(symbols)
        for many, length in steps:
            counts[length - 1] += min(many, left)
            left -= min(many, left)
        counts[length - 1] += left
        return cls(bytes(counts), bytes(symbols))

    def body(self, kind: int) -> bytes:
        return bytes([kind]) + self.counts + self.symbols


@cache
def _looked_up(counts: bytes, symbols: bytes) -> Huffman:
    return Huffman(counts, symbols)


def _tables() -> tuple[Huffman, Huffman]:
    """Sizes near those of letters rank first, then short runs."""
    near = sorted(range(12), key=lambda s: (abs(s - 5), s))
    pairs = sorted(((run, size) for run in range(16) for size in range(1, 11)), key=lambda p: (3 * p[0] + abs(p[1] - 5), p))
    ranked = [run << 4 | size for run, size in pairs]
    ranked[4:4] = [_END, _ZEROS]
    return Huffman.ranked(near, [(4, 3), (4, 4), (4, 5)]), Huffman.ranked(ranked, [(2, 2), (2, 4), (4, 5), (8, 7), (16, 9), (130, 12)])


DC, AC = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _bits_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size of each value, and its extra bits."""
    size = _SIZE[np.abs(v)]
    return size, np.where(v >= 0, v, v + (1 << size) - 1).astype(np.uint64)


def entropy_coded(v: np.ndarray, restart: int = RESTART, dc: Huffman = DC, ac: Huffman = AC) -> bytes:
    """The scan of grey blocks (rows of 64 coefficients in scan order)."""
    n = len(v)
    value, width = np.zeros((n, BLOCK + 2), np.uint64), np.zeros((n, BLOCK + 2), np.int64)
    before = np.concatenate([[0], v[:-1, 0]])
    before[::restart] = 0
    size, bits = _bits_of(v[:, 0] - before)
    value[:, 0], width[:, 0] = dc.code[size] << size.astype(np.uint64) | bits, dc.length[size] + size
    row, k = np.nonzero(v[:, 1:])
    k = k + 1
    size, bits = _bits_of(v[row, k])
    run = k - np.where(np.concatenate([[-1], row[:-1]]) == row, np.concatenate([[0], k[:-1]]), 0) - 1
    symbol = (run & 15) << 4 | size
    coded, wide = ac.code[symbol] << size.astype(np.uint64) | bits, ac.length[symbol] + size
    for z in (1, 2, 3):
        more = run >= 16 * z
        coded[more] |= ac.code[_ZEROS] << wide[more].astype(np.uint64)
        wide[more] += ac.length[_ZEROS]
    value[row, k], width[row, k] = coded, wide
    last = np.zeros(n, np.int64)
    last[row] = k
    open_ = last < BLOCK - 1
    value[open_, BLOCK], width[open_, BLOCK] = ac.code[_END], ac.length[_END]
    # An interval is filled up to a whole byte with ones.
    ends = np.minimum(np.arange(restart, n + restart, restart), n)
    total = np.add.reduceat(width.sum(1), np.arange(0, n, restart))
    fill = -total & 7
    value[ends - 1, BLOCK + 1], width[ends - 1, BLOCK + 1] = (1 << fill) - 1, fill
    used = np.flatnonzero(width.reshape(-1))
    value, width = value.reshape(-1)[used], width.reshape(-1)[used]
    after = np.cumsum(width)
    at = after - width
    word, room = at >> 6, 64 - (at & 63) - width
    out = np.zeros(int(after[-1] >> 6) + 2, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    high = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    out[word[first]] = np.add.reduceat(high, first)
    over = np.flatnonzero(room < 0)
    out[word[over] + 1] += value[over] << (64 + room[over]).astype(np.uint64)
    data = out.astype(">u8").view(np.uint8)[: int(after[-1] >> 3)]
    marks = np.cumsum((total + fill) >> 3)[:-1]
    stuffed = np.flatnonzero(data == 0xFF) + 1
    places = np.concatenate([stuffed, np.repeat(marks, 2)])
    added = np.concatenate([np.zeros(len(stuffed), np.uint8), np.column_stack([np.full(len(marks), 0xFF), 0xD0 + np.arange(len(marks)) % 8]).reshape(-1).astype(np.uint8)])
    return np.insert(data, places, added).tobytes()


def encode(payload: bytes) -> bytes:
    blocks = -(-len(payload) // BLOCK)
    across = 3
    while -(-blocks // across) > 8191:
        across *= 2
    down = max(1, -(-blocks // across))
    data = np.full((across * down, BLOCK), MIDDLE, np.int64)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    head = b"\xff\xd8" + _segment(0xFE, struct.pack(">Q", len(payload))) + _segment(0xDB, bytes([0]) + bytes([1]) * 64)
    head += _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * down, 8 * across, 1, 1, 0x11, 0))
    head += _segment(0xC4, DC.body(0x00) + AC.body(0x10)) + _segment(0xDD, struct.pack(">H", RESTART)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    return head + entropy_coded(data - MIDDLE) + b"\xff\xd9"


@dataclass
class Scan:
    """One scan: its bytes without markers and stuffing, where its intervals start, and how blocks follow each other."""

    data: np.ndarray
    starts: np.ndarray
    blocks: int  # of one interval; the last may have fewer
    total: int
    parts: list[int]  # component of each block of a unit
    dc: list[Huffman]
    ac: list[Huffman]
    out: np.ndarray | None = None


@dataclass
class Image:
    width: int = 0
    height: int = 0
    length: int | None = None
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantiser
    quant: dict[int, int] = field(default_factory=dict)  # of DC coefficients
    scans: list[tuple[list[int], Scan]] = field(default_factory=list)


def _scan_of(stored: bytes, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bytes of a scan, starts of its intervals, and where the next marker is."""
    end = at
    while True:
        end = stored.find(b"\xff", end)
        if end < 0 or end + 1 >= len(stored):
            end = len(stored)
            break
        if stored[end + 1] == 0 or 0xD0 <= stored[end + 1] <= 0xD7:
            # Most of these stand in the middle; jump over all up to the last possible end.
            far = stored.rfind(b"\xff\xd9")
            inner = np.frombuffer(stored, np.uint8, max(far, end + 2) - end, end)
            marks = np.flatnonzero(inner[:-1] == 0xFF)
            real = marks[(inner[marks + 1] != 0) & ((inner[marks + 1] < 0xD0) | (inner[marks + 1] > 0xD7)) & (inner[marks + 1] != 0xFF)]
            end = end + int(real[0]) if len(real) else max(far, end + 2)
        break
    data = np.frombuffer(stored, np.uint8, end - at, at)
    ff = np.flatnonzero(data[:-1] == 0xFF)
    follow = data[ff + 1]
    keep = np.ones(len(data), bool)
    keep[ff[follow == 0] + 1] = False
    marks = ff[(follow >= 0xD0) & (follow <= 0xD7)]
    keep[marks] = keep[marks + 1] = False
    starts = np.concatenate([[0], np.cumsum(keep)[marks]]) if len(marks) else np.zeros(1, np.int64)
    return data[keep], starts, end


def parse(stored: bytes) -> Image:
    """Markers and scans of a baseline JPEG."""
    if stored[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, restart, image = 2, {}, 0, Image()
    while at < len(stored):
        while stored[at + 1 : at + 2] == b"\xff":  # filling
            at += 1
        marker = stored[at + 1]
        if marker == 0xD9:
            break
        size = struct.unpack(">H", stored[at + 2 : at + 4])[0]
        body, at = stored[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE and len(body) == 8:
            image.length = struct.unpack(">Q", body)[0]
        elif marker == 0xDB:
            p = 0
            while p < len(body):
                wide = body[p] >> 4
                image.quant[body[p] & 15] = struct.unpack(">H", body[p + 1 : p + 3])[0] if wide else body[p + 1]
                p += 1 + 64 * (1 + wide)
        elif marker == 0xC0:
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            p = 0
            while p < len(body):
                n = sum(body[p + 1 : p + 17])
                tables[body[p]] = _looked_up(body[p + 1 : p + 17], body[p + 17 : p + 17 + n])
                p += 17 + n
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            ids = [p[0] for p in image.parts]
            chosen = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            data, starts, at = _scan_of(stored, at)
            pattern, units = _layout(image, [c for c, _ in chosen])
            many = restart or units
            image.scans.append(([c for c, _ in chosen], Scan(data, starts, many * len(pattern), units * len(pattern), pattern, [tables[t >> 4] for _, t in chosen], [tables[16 | t & 15] for _, t in chosen])))
    return image


def _layout(image: Image, chosen: list[int]) -> tuple[list[int], int]:
    """Components (by place in the scan) of a unit's blocks, and the number of units."""
    most_across, most_down = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    if len(chosen) == 1:
        _, h, v, _ = image.parts[chosen[0]]
        return [0], -(-(-(-image.width * h // most_across)) // 8) * -(-(-(-image.height * v // most_down)) // 8)
    pattern = [k for k, c in enumerate(chosen) for _ in range(image.parts[c][1] * image.parts[c][2])]
    return pattern, -(-image.width // (8 * most_across)) * -(-image.height // (8 * most_down))


def decode_scans(scans: list[Scan]) -> None:
    """Coefficients of all scans into their ``out``, intervals side by side."""
    tables: dict[int, int] = {}
    for s in scans:
        for t in (*s.dc, *s.ac):
            tables.setdefault(id(t), len(tables))
    known = {id(t): t for s in scans for t in (*s.dc, *s.ac)}
    used = np.concatenate([known[k].used for k in tables])
    found = np.concatenate([known[k].found for k in tables])
    data = np.concatenate([s.data for s in scans] + [np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    rows = max(len(s.parts) for s in scans)
    kinds = np.zeros((len(scans), rows, 3), np.int64)
    for i, s in enumerate(scans):
        for j, c in enumerate(s.parts):
            kinds[i, j] = c, tables[id(s.dc[c])] << 16, tables[id(s.ac[c])] << 16
    unit = np.array([len(s.parts) for s in scans])
    base = np.cumsum([0] + [len(s.data) for s in scans])
    first = np.cumsum([0] + [s.total for s in scans])
    out = np.zeros((int(first[-1]), BLOCK), np.int32)
    bit, of, block, last = [], [], [], []
    for i, s in enumerate(scans):
        n = -(-s.total // s.blocks)
        if len(s.starts) < n:
            raise ValueError("restart markers are missing")
        bit.append(8 * (base[i] + s.starts[:n]))
        of.append(np.full(n, i))
        block.append(first[i] + s.blocks * np.arange(n))
        last.append(np.minimum(first[i] + s.blocks * np.arange(1, n + 1), first[i + 1]))
    bit, of, block, last = (np.concatenate(x) for x in (bit, of, block, last))
    origin, k = first[of], np.zeros(len(bit), np.int64)
    before = np.zeros((len(bit), int(kinds[:, :, 0].max()) + 1), np.int64)
    alone = rows == 1
    flat = out.reshape(-1)
    while len(bit):
        kind = kinds[of, 0] if alone else kinds[of, (block - origin) % unit[of]]
        start = k == 0
        entry = np.where(start, kind[:, 1], kind[:, 2]) + ((window[bit >> 3] << (bit & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64)
        symbol, length = found[entry].astype(np.int64), used[entry]
        if not length.all():
            raise ValueError("no such Huffman code")
        bit = bit + length
        size = np.where(start, symbol, symbol & 15)
        raw = ((window[bit >> 3] << (bit & 7).astype(np.uint32)).astype(np.int64)) >> (32 - size)
        v = np.where(raw >> np.maximum(size - 1, 0) == 0, raw - (1 << size) + 1, raw)
        v[size == 0] = 0
        bit = bit + size
        if start.any():
            at = np.flatnonzero(start)
            c = kind[at, 0]
            before[at, c] += v[at]
            v[at] = before[at, c]
        k = np.where(start, 0, k + (symbol >> 4))
        # A run without a value is sixteen zeros, or the end of the block.
        none = ~start & (size == 0)
        if (k >= BLOCK).any():
            raise ValueError("a run leaves its block")
        put = ~none
        flat[block[put] * BLOCK + k[put]] = v[put]
        k = np.where(none & (symbol == _END), BLOCK, k + 1)
        over = k >= BLOCK
        if over.any():
            block, k = block + over, np.where(over, 0, k)
            live = block < last
            if not live.all():
                bit, of, block, last, origin, k, before = (x[live] for x in (bit, of, block, last, origin, k, before))
    for i, s in enumerate(scans):
        s.out = out[first[i] : first[i + 1]]


def _light(image: Image) -> np.ndarray:
    """Luminance of each block, from DC coefficients alone."""
    across, down, quantiser = image.parts[0][1:]
    most_across, most_down = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    chosen, scan = next((c, s) for c, s in image.scans if 0 in c)
    wide = -(-(-(-image.width * across // most_across)) // 8)
    high = -(-(-(-image.height * down // most_down)) // 8)
    if len(chosen) == 1:
        light = scan.out[:, 0].reshape(high, wide)
    else:
        place = [i for i, c in enumerate(scan.parts) if c == chosen.index(0)]
        units = -(-image.width // (8 * most_across))
        light = scan.out[:, 0].reshape(-1, len(scan.parts))[:, place].reshape(-1, units, down, across).transpose(0, 2, 1, 3).reshape(-1, units * across)[:high, :wide]
    return np.clip(light * image.quant.get(quantiser, 1) / 8 + 128, 0, 255).astype(np.uint8)


def decode(stored: list[bytes]) -> list[dict]:
    """Of each image: dimensions, coefficients of its first scan in scan order, and the DC-only thumbnail."""
    images = [parse(s) for s in stored]
    scans = [s for image in images for _, s in image.scans]
    if scans:
        decode_scans(scans)
    return [{"width": i.width, "height": i.height, "length": i.length, "coefficients": i.scans[0][1].out, "thumbnail": _light(i)} for i in images]


def payload_from(decoded: dict) -> bytes:
    return (decoded["coefficients"].reshape(-1)[: decoded["length"]] + MIDDLE).astype(np.uint8).tobytes()


def thumbnail_hash(light: np.ndarray) -> str:
    """Which cells of an 8 x 8 reduction are above its mean, as hex."""
    r, c = (np.linspace(0, n, 9).astype(int) for n in light.shape)
    # Edges of cells in the running sums; a cell has one row and column at least.
    low_r, low_c = np.minimum(r[:-1], light.shape[0] - 1), np.minimum(c[:-1], light.shape[1] - 1)
    high_r, high_c = np.maximum(r[1:], low_r + 1), np.maximum(c[1:], low_c + 1)
    total = np.zeros((light.shape[0] + 1, light.shape[1] + 1))
    total[1:, 1:] = light.cumsum(0, dtype=float).cumsum(1)
    cells = total[np.ix_(high_r, high_c)] - total[np.ix_(low_r, high_c)] - total[np.ix_(high_r, low_c)] + total[np.ix_(low_r, low_c)]
    small = cells / np.outer(high_r - low_r, high_c - low_c)
    return np.packbits(small > small.mean()).tobytes().hex()


def _groups(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(raws):
        end, size = at + 1, len(raws[at])
        while end < len(raws) and size + len(raws[end]) <= TOGETHER:
            size += len(raws[end])
            end += 1
        yield at, end
        at = end


def media(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """Stored form, what is read back from it, dimensions and thumbnail hashes of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws, ids = [t.encode("utf-8", "replace") for t in batch.text], batch._id.tolist()
            for a, b in _groups(raws):
                stored = [encode(payload_of(raw)) for raw in raws[a:b]]
                out = []
                for doc_id, raw, s, seen in zip(ids[a:b], raws[a:b], stored, decode(stored), strict=True):
                    back = payload_from(seen)
                    feature = f"{seen['width']}x{seen['height']}:{thumbnail_hash(seen['thumbnail'])}:{zlib.crc32(seen['thumbnail'].tobytes()):08x}"
                    row = (doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(s), hashlib.sha256(s).hexdigest(), feature)
                    out.append((*row, s) if keep_media else row)
                yield pd.DataFrame(out, columns=names)

    names = ["_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * keep_media
    schema = "_id string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    source = docs.select(F.col("doc_id").cast("string").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    done = source.mapInPandas(run, schema + (", media binary" if keep_media else ""))
    return done.select(F.col("_id").cast("bigint").alias("doc_id"), *names[1:])


def op7_baseline_jpeg(spark, sf_dir):
    return media(table(spark, sf_dir, "documents"), keep_media=False)
