"""AVI motion-JPEG: write, index, decode, and cut into shots.

``decode_avi`` reads RIFF AVI files with JPEG frames: it follows the OpenDML
indexes of all parts or ``idx1`` (and walks ``movi`` where there is neither) and
decodes frames of the two sequential Huffman processes, DCT and lossless, with
any sampling of their components, restart intervals, and the standard tables
where a frame has none of its own. Shots are found in the first component, the
luma. ``encode_avi`` stores 8-bit samples in lossless frames. Its Huffman table gives category c a code of
9 - c bits, so that every difference takes nine bits with its extra bits; the
fixed width lets frames be coded and decoded as whole arrays, while the file
remains ordinary JPEG.

Shots: a frame's grey histogram is compared with the previous one's. A cut needs
a difference above a floor and above the mean plus three deviations of the
current shot's recent differences.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

WIDTH, HEIGHT, RATE = 64, 16, 25
BINS, FLOOR, RECENT, DEVIATIONS = 32, 0.35, 12, 3.0
UNIT = 64
#: Frames coded or decoded at once.
BLOCK = 2048

# JPEG marker codes, and the order in which a block's coefficients are stored.
SOI, EOI, SOS, DHT, DQT, DRI = 0xD8, 0xD9, 0xDA, 0xC4, 0xDB, 0xDD
BASELINE, EXTENDED, LOSSLESS = 0xC0, 0xC1, 0xC3

# The typical Huffman tables of the JPEG standard (how many codes of each length, then the symbols),
# which motion-JPEG frames may leave out; by class (0 differences, 1 coefficients) and number.
STANDARD = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728"
        "292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a83848586878889"
        "8a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2"
        "e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: (
        "00020102040403040705040400010277",
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a26"
        "2728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a828384858687"
        "88898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9da"
        "e2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}


def zigzag() -> np.ndarray:
    """Raster index of each stored coefficient: diagonals in alternating direction."""
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * y + x for y, x in order])


def _segment(marker: int, body: bytes = b"", bare: bool = False) -> bytes:
    return bytes((0xFF, marker)) + (b"" if bare else struct.pack(">H", len(body) + 2) + body)


# ---------------------------------------------------------------- encoding


@lru_cache(maxsize=1)
def _nine_bit() -> tuple[bytes, np.ndarray]:
    """The table of the fixed-width code, and the nine bits of every difference + 255."""
    counts = [sum(9 - c == n for c in range(9)) for n in range(1, 17)]
    table = bytes([0, *counts, *sorted(range(9), key=lambda c: 9 - c)])
    bits = np.zeros(511, np.uint16)
    code, width = 0, 0
    for c in sorted(range(9), key=lambda c: 9 - c):
        code <<= 9 - c - width
        width = 9 - c
        for d in range(-255, 256):
            if abs(d).bit_length() == c:
                bits[d + 255] = code << c | (d if d > 0 else d + (1 << c) - 1)
        code += 1
    return table, bits


def _frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG (predictor: left neighbour) of each (height, width) array."""
    n, height, width = samples.shape
    table, bits = _nine_bit()
    d = samples.astype(np.int16)
    d[:, :, 1:] -= samples[:, :, :-1]
    d[:, 1:, 0] -= samples[:, :-1, 0]
    d[:, 0, 0] -= 128
    codes = bits[d.reshape(n, -1) + 255]
    # Eight codes of nine bits make nine bytes.
    c = codes.reshape(n, -1, 8)
    out = np.empty((n, c.shape[1], 9), np.uint8)
    for k in range(9):
        # Byte k holds the last k bits of code k - 1 and the first 8 - k of code k.
        high = c[:, :, k - 1] << (8 - k) if k else 0
        low = c[:, :, k] >> (k + 1) if k < 8 else 0
        out[:, :, k] = (high | low) & 0xFF
    head = (
        _segment(SOI, bare=True)
        + _segment(LOSSLESS, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0))
        + _segment(DHT, table)
        + _segment(SOS, bytes((1, 1, 0, 1, 0, 0)))
    )
    raw = out.reshape(n, -1)
    return [head + r.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for r in raw]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def mux_avi(frames: list[bytes], width: int, height: int, rate: int = RATE, note: bytes = b"") -> bytes:
    """A RIFF AVI of one video stream with an ``idx1`` index."""
    most = max(map(len, frames), default=0)
    header = struct.pack("<14I", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height, *[0] * 4)
    stream = struct.pack(
        "<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0, 0, 0, 0, width, height
    )
    bitmap = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", header) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", bitmap)))
    head += _list(b"INFO", _chunk(b"ICMT", note)) if note else b""
    body, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body += [b"00dc" + struct.pack("<I", len(f)), f, b"\0" * (len(f) % 2)]
        at += 8 + len(f) + len(f) % 2
    tail = _chunk(b"idx1", b"".join(index))
    size = 4 + len(head) + 8 + at + len(tail)
    start = b"RIFF" + struct.pack("<I", size) + b"AVI " + head + b"LIST" + struct.pack("<I", at) + b"movi"
    return b"".join([start, *body, tail])


def encode_avi(payload: bytes, width: int = WIDTH, height: int = HEIGHT) -> bytes:
    """Store a payload of whole rows as grey frames; the last is filled with zeros."""
    height = min(height, len(payload) // width)
    size = width * height
    n = -(-len(payload) // size)
    samples = np.frombuffer(payload.ljust(n * size, b"\0"), np.uint8).reshape(n, height, width)
    frames = [f for at in range(0, n, BLOCK) for f in _frames(samples[at : at + BLOCK])]
    return mux_avi(frames, width, height, note=str(len(payload)).encode())


# ---------------------------------------------------------------- decoding


def _chunks(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        yield name, at + 8, min(end, at + 8 + size)
        at += 8 + size + size % 2


def _video(name: bytes) -> bool:
    return name[2:] in (b"dc", b"db")


def _walk(raw: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Video chunks of a ``movi`` list, those grouped in ``rec`` lists included."""
    for name, a, b in _chunks(raw, at, end):
        if name == b"LIST" and raw[a : a + 4] == b"rec ":
            yield from ((c, d) for sub, c, d in _chunks(raw, a + 4, b) if _video(sub))
        elif _video(name):
            yield a, b


def _standard_index(raw: bytes, at: int) -> Iterator[tuple[int, int]]:
    """Frames an OpenDML index chunk (its header at ``at``) names."""
    wide, kind, n, name, base = struct.unpack_from("<HxBI4sQ", raw, at + 8)
    if (wide, kind) != (2, 1) or not _video(name):
        return
    for k in range(n):
        offset, size = struct.unpack_from("<II", raw, at + 32 + 8 * k)
        yield base + offset, base + offset + (size & 0x7FFFFFFF)


def parse_avi(raw: bytes) -> dict:
    """Frame rate, note and the (start, end) of every video chunk, in all parts of the file."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    rate, note, movi, index, indexes = float(RATE), b"", [], None, []
    parts = [(a, b) for name, a, b in _chunks(raw, 0, len(raw)) if name == b"RIFF" and raw[a : a + 4] in (b"AVI ", b"AVIX")]
    for first, (p, q) in enumerate(parts):
        for name, a, b in _chunks(raw, p + 4, q):
            kind = raw[a : a + 4] if name == b"LIST" else b""
            if kind == b"hdrl":
                for sub, c, d in _chunks(raw, a + 4, b):
                    video = False
                    for x, e, f in _chunks(raw, c + 4, d) if sub == b"LIST" else ():
                        if x == b"strh" and raw[e : e + 4] == b"vids":
                            video = True
                            scale, per = struct.unpack_from("<II", raw, e + 20)
                            rate = per / scale if scale and per else rate
                        elif x == b"indx" and video and struct.unpack_from("<HxB", raw, e) == (4, 0):
                            n = min(int.from_bytes(raw[e + 4 : e + 8], "little"), (f - e - 24) // 16)
                            indexes += [int.from_bytes(raw[e + 24 + 16 * k :][:8], "little") for k in range(n)]
            elif kind == b"INFO":
                note = next((raw[c:d] for x, c, d in _chunks(raw, a + 4, b) if x == b"ICMT"), note)
            elif kind == b"movi":
                movi.append((a, b))
            elif name == b"idx1" and not first:
                index = (a, b)
    spans: list[tuple[int, int]] = []
    if indexes:
        spans = [span for at in indexes for span in _standard_index(raw, at)]
    elif movi and index:
        entries = np.frombuffer(raw, "<u4", (index[1] - index[0]) // 16 * 4, index[0]).reshape(-1, 4)
        video = [e for e in entries.tolist() if _video(e[0].to_bytes(4, "little"))]
        # Offsets count from the list's kind, or in some files from the file's begin.
        base = 0 if video and video[0][2] >= movi[0][0] else movi[0][0]
        spans = [(base + e[2] + 8, base + e[2] + 8 + e[3]) for e in video]
        movi = movi[1:]
    if not indexes:
        spans += [span for a, b in movi for span in _walk(raw, a + 4, b)]
    return {"rate": rate, "note": note, "spans": spans}


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, at = {}, 0, 0
    for width, n in enumerate(counts, 1):
        for _ in range(n):
            out[width, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


@lru_cache(maxsize=32)
def _lookup(counts: bytes, symbols: bytes) -> array:
    """For any 16 bits ahead, width << 8 | symbol of the code they begin with; 0 if none does."""
    out = np.zeros(1 << 16, np.uint16)
    for (width, code), symbol in _codes(counts, symbols).items():
        out[code << 16 - width : (code + 1) << 16 - width] = width << 8 | symbol
    return array("H", out.tobytes())


class _Bits:
    def __init__(self, raw: bytes):
        b = np.frombuffer(raw.replace(b"\xff\x00", b"\xff") + bytes(4), np.uint8).astype(np.uint32)
        #: The 32 bits from each byte on.
        self.ahead = array("I", (b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]).tobytes())
        self.at, self.end = 0, 8 * (len(b) - 4)

    def symbol(self, table: array) -> int:
        at = self.at
        if at >= self.end:
            raise ValueError("entropy-coded data ended early")
        found = table[self.ahead[at >> 3] >> 16 - (at & 7) & 0xFFFF]
        if not found:
            raise ValueError("no such Huffman code")
        self.at = at + (found >> 8)
        return found & 0xFF

    def signed(self, n: int) -> int:
        if not n:
            return 0
        at, self.at = self.at, self.at + n
        if n > 16 or self.at > self.end:
            raise ValueError("entropy-coded data ended early")
        v = self.ahead[at >> 3] >> 32 - n - (at & 7) & (1 << n) - 1
        return v if v >> (n - 1) else v - (1 << n) + 1


@lru_cache(maxsize=1)
def _standard() -> dict[int, tuple[bytes, bytes]]:
    return {k: (bytes.fromhex(counts), bytes.fromhex(symbols)) for k, (counts, symbols) in STANDARD.items()}


def _header(raw: bytes) -> tuple[dict, int]:
    """Tables and frame parameters up to the first scan, and where its data begin."""
    h: dict = {"huff": dict(_standard()), "quant": {}, "restart": 0}
    at = 2
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    while True:
        while raw[at : at + 2] == b"\xff\xff":  # fill bytes
            at += 1
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        if raw[at] != 0xFF or size < 2:
            raise ValueError("no marker where one must stand")
        at += 2 + size
        if marker == DHT:
            while body:
                n = sum(body[1:17])
                h["huff"][body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == DQT:
            while body:
                wide = body[0] >> 4
                h["quant"][body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == DRI:
            h["restart"] = int.from_bytes(body[:2], "big")
        elif marker in (BASELINE, EXTENDED, LOSSLESS):
            bits, h["height"], h["width"], n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not h["height"] or not h["width"]:
                raise ValueError("only frames of 8 bits and stated size are decoded")
            h["process"], h["parts"] = marker, {}
            for k in range(6, 6 + 3 * n, 3):
                h["parts"][body[k]] = (body[k + 1] >> 4, body[k + 1] & 15, body[k + 2])
                if not 0 < body[k + 1] >> 4 <= 4 or not 0 < body[k + 1] & 15 <= 4:
                    raise ValueError("no such sampling")
        elif marker == SOS:
            n = body[0]
            h["scan"] = [(body[k], body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * n, 2)]
            h["predictor"], h["shift"] = body[1 + 2 * n], body[3 + 2 * n] & 15
            return h, at
        elif 0xC5 <= marker <= 0xCF or marker in (0xC2,):
            raise ValueError("not a sequential Huffman frame")


def _intervals(h: dict, data: bytes, units: int) -> Iterator[tuple[_Bits, range]]:
    """The scan's data between restarts, with the units each holds."""
    parts = re.split(rb"\xff[\xd0-\xd7]", data) if h["restart"] else [data]
    each = h["restart"] or units
    if len(parts) * each < units:
        raise ValueError("restart intervals are missing")
    for at, part in zip(range(0, units, each), parts, strict=False):
        yield _Bits(part), range(at, min(units, at + each))


def _lossless(h: dict, data: bytes) -> list[np.ndarray]:
    height, width, n, shift = h["height"], h["width"], len(h["scan"]), h["shift"]
    if any(h["parts"][c][:2] != (1, 1) for c, *_ in h["scan"]) and n > 1:
        raise ValueError("only lossless frames without subsampling are decoded")
    if h["restart"] % width or height * width * n > 8 * len(data) or h["predictor"] not in range(1, 8):
        raise ValueError("not a sound lossless scan")
    tables = [_lookup(*h["huff"][t]) for _, t, _ in h["scan"]]
    out = np.zeros((n, height, width), np.int64)
    for bits, units in _intervals(h, data, height * width):
        top = units.start // width
        d = np.array([bits.signed(bits.symbol(t)) for _ in units for t in tables], np.int64)
        d = d.reshape(-1, width, n).transpose(2, 0, 1)
        d[:, 0, 0] += 128 >> shift
        rows = d.shape[1]
        if h["predictor"] == 1:
            d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
            out[:, top : top + rows] = np.cumsum(d, axis=2)
            continue
        for k in range(n):
            above: list[int] = []
            for y in range(rows):
                line, wanted = [], d[k, y].tolist()
                for x, v in enumerate(wanted):
                    if not y:
                        guess = line[x - 1] if x else 0
                    elif not x:
                        guess = above[0]
                    else:
                        guess = _predict(h["predictor"], line[x - 1], above[x], above[x - 1])
                    line.append(v + guess & 0xFFFF)
                out[k, top + y] = above = line
    return list((out << shift & 0xFF).astype(np.uint8))


def _predict(kind: int, left: int, above: int, corner: int) -> int:
    if kind == 2:
        return above
    if kind == 3:
        return corner
    if kind == 4:
        return left + above - corner
    if kind == 5:
        return left + (above - corner >> 1)
    if kind == 6:
        return above + (left - corner >> 1)
    return left + above >> 1


@lru_cache(maxsize=1)
def _differences() -> np.ndarray:
    _, bits = _nine_bit()
    out = np.zeros(512, np.int16)
    out[bits] = np.arange(-255, 256)
    return out


def _lossless_all(h: dict, data: np.ndarray) -> np.ndarray:
    """Frames of one header and the nine-bit code, all at once."""
    n, height, width = len(data), h["height"], h["width"]
    raw = data.reshape(n, -1, 9).astype(np.uint16)
    codes = np.empty((n, raw.shape[1], 8), np.uint16)
    for k in range(8):
        codes[:, :, k] = (raw[:, :, k] << (k + 1) | raw[:, :, k + 1] >> (7 - k)) & 0x1FF
    d = _differences()[codes].reshape(n, height, width)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16)
    return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8)


@lru_cache(maxsize=1)
def cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    return np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k, 0.5, np.sqrt(1 / 8))


def _block(bits: _Bits, dc: array, ac: array, last: int, out: np.ndarray) -> int:
    """One block's coefficients in stored order into ``out``; gives its first one."""
    last += bits.signed(bits.symbol(dc))
    out[0] = last
    k = 1
    while k < 64:
        run, size = divmod(bits.symbol(ac), 16)
        if not size and run != 15:
            break
        k += run
        if k > 63:
            raise ValueError("a run leaves its block")
        if size:
            out[k] = bits.signed(size)
        k += 1
    return last


def _baseline(h: dict, data: bytes) -> list[np.ndarray]:
    height, width, parts = h["height"], h["width"], h["parts"]
    across, down = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    # (blocks of one unit across and down, tables, blocks as rows, columns, coefficients)
    grid, scan = (-(-height // (8 * down)), -(-width // (8 * across))), []
    for c, dc, ac in h["scan"]:
        x, y, _ = parts[c]
        if len(h["scan"]) == 1:  # a scan of one component has units of one block and no filling
            grid = (-(-(-(-height * y // down)) // 8), -(-(-(-width * x // across)) // 8))
            x = y = 1
        scan.append((x, y, _lookup(*h["huff"][dc]), _lookup(*h["huff"][0x10 | ac]), (grid[0] * y, grid[1] * x)))
    if sum(r * c for *_, (r, c) in scan) > 4 * len(data):
        raise ValueError("more blocks than the data can hold")
    blocks = [np.zeros((*shape, 64)) for *_, shape in scan]
    for bits, units in _intervals(h, data, grid[0] * grid[1]):
        last = [0] * len(scan)
        for unit in units:
            row, col = divmod(unit, grid[1])
            for k, (x, y, dc, ac, _) in enumerate(scan):
                for j in range(y):
                    for i in range(x):
                        last[k] = _block(bits, dc, ac, last[k], blocks[k][row * y + j, col * x + i])
    out, c = [], cosines()
    for (name, *_), found in zip(h["scan"], blocks, strict=True):
        x, y, quant = parts[name]
        raster = np.zeros_like(found)
        raster[..., zigzag()] = found * h["quant"][quant]
        pixels = np.einsum("ky,rckl,lx->rycx", c, raster.reshape(*found.shape[:2], 8, 8), c) + 128
        plane = np.clip(np.rint(pixels), 0, 255).astype(np.uint8).reshape(found.shape[0] * 8, -1)
        if (x, y) != (across, down):  # repeat samples up to the frame's size
            rows, cols = np.arange(height) * y // down, np.arange(width) * x // across
            plane = plane[rows[:, None], cols[None]]
        out.append(plane[:height, :width])
    return out


def decode_planes(raw: bytes) -> list[np.ndarray]:
    """The components of one JPEG frame's first scan, each (height, width) of 8 bits; ValueError if it is damaged."""
    try:
        h, at = _header(raw)
        end = raw.rfind(b"\xff\xd9")
        data = raw[at : end if end >= at else len(raw)]
        return _lossless(h, data) if h["process"] == LOSSLESS else _baseline(h, data)
    except (LookupError, struct.error) as e:
        raise ValueError(f"damaged frame: {e}") from e


def decode_frame(raw: bytes) -> np.ndarray:
    """Samples of one JPEG frame's first component (grey or luma), (height, width) of 8 bits."""
    return decode_planes(raw)[0]


def frame_blocks(raw: bytes, spans: list[tuple[int, int]], lenient: bool = False) -> Iterator[tuple[np.ndarray, int]]:
    """The frames at ``spans`` as arrays (n, height, width) of some frames each, and how many of them are stand-ins.

    An empty chunk shows the frame before once more, as AVI has it; with
    ``lenient`` so does a damaged frame or one of another size. Such chunks
    before the first frame are left out.
    """
    code, before = _nine_bit()[0], None
    for at in range(0, len(spans), BLOCK):
        part = spans[at : at + BLOCK]
        try:
            h, skip = _header(raw[slice(*part[0])])
            head, size = raw[part[0][0] : part[0][0] + skip], h["height"] * h["width"] * 9 // 8
            plain = h["process"] == LOSSLESS and h["predictor"] == 1 and not (h["restart"] or h["shift"] or size % 9)
            plain = plain and len(h["scan"]) == 1 and h["huff"][h["scan"][0][1]] == (code[1:17], code[17:])
        except (ValueError, LookupError, struct.error):
            plain = False
        if plain:
            data = [raw[x + skip : y - 2].replace(b"\xff\x00", b"\xff") for x, y in part if raw[x : x + skip] == head]
            same = before is None or before.shape == (h["height"], h["width"])
            if same and len(data) == len(part) and all(len(d) == size for d in data):
                found = _lossless_all(h, np.frombuffer(b"".join(data), np.uint8).reshape(len(data), size))
                before = found[-1]
                yield found, 0
                continue
        for x, y in part:
            lost = x == y
            try:
                frame = before if lost else decode_frame(raw[x:y])
                if before is not None and frame.shape != before.shape:
                    raise ValueError("frames of several sizes")
            except ValueError:
                if not lenient:
                    raise
                frame, lost = before, True
            if frame is not None:
                before = frame
                yield frame[None], int(lost and x != y)


def decode_avi(raw: bytes) -> tuple[np.ndarray, dict]:
    """Every frame of an AVI as (n, height, width), and what its index and header say; ValueError if it is damaged."""
    try:
        info = parse_avi(raw)
    except struct.error as e:
        raise ValueError(f"damaged file: {e}") from e
    found = [f for f, _ in frame_blocks(raw, info["spans"])]
    return np.concatenate(found) if found else np.zeros((0, 0, 0), np.uint8), info


def histograms(frames: np.ndarray) -> np.ndarray:
    """Share of each grey level's bin, per frame."""
    n = len(frames)
    flat = frames.reshape(n, -1)
    out = np.empty((n, BINS))
    for at in range(0, n, BLOCK):
        part = flat[at : at + BLOCK]
        cell = (part >> 3).astype(np.int32) + np.arange(len(part), dtype=np.int32)[:, None] * BINS
        out[at : at + BLOCK] = np.bincount(cell.ravel(), minlength=len(part) * BINS).reshape(-1, BINS) / flat.shape[1]
    return out


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges (end exclusive) between cuts."""
    return cuts_of(histograms(frames)) if len(frames) else []


def cuts_of(hist: np.ndarray) -> list[tuple[int, int]]:
    n = len(hist)
    difference = (np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2).tolist()
    cuts, recent = [0], []
    for i, d in enumerate(difference, 1):
        limit = FLOOR
        if recent:
            mean = sum(recent) / len(recent)
            spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5
            limit = max(FLOOR, mean + DEVIATIONS * spread)
        if d > limit:
            cuts.append(i)
            recent = []
        else:
            recent = [*recent[1 - RECENT :], d]
    return list(zip(cuts, [*cuts[1:], n], strict=True))


CLIPS = "doc_id long, clip int, first_frame int, end_frame int, start_s double, end_s double, mean_level double, status string"


def clips(raw: bytes) -> list[tuple]:
    """Timed clip rows of one file: number, frames, seconds, mean grey level, status.

    The status is ``ok`` or tells how many frames were damaged; these show the
    frame before once more. A file without any sound frame gives one row with
    the reason as status and nulls.
    """
    hist, levels, damaged = [], [], 0
    try:
        info = parse_avi(raw)
        for frames, lost in frame_blocks(raw, info["spans"], lenient=True):
            hist.append(histograms(frames))
            levels += frames.reshape(len(frames), -1).mean(axis=1).tolist()
            damaged += lost
    except (ValueError, LookupError, struct.error) as e:
        return [(None, None, None, None, None, None, f"not decoded: {e}")]
    if not levels:
        return [(None, None, None, None, None, None, "not decoded: no sound frame")]
    sound = "ok" if not damaged else f"{damaged} damaged frames"
    rate = info["rate"]
    return [
        (i, a, b, a / rate, b / rate, sum(levels[a:b]) / (b - a), sound) for i, (a, b) in enumerate(cuts_of(np.concatenate(hist)))
    ]


def avi_clips(media: DataFrame) -> DataFrame:
    """Clip rows of every file of ``media`` (``doc_id``, ``media`` binary), see ``clips``.

    Null files have none; malformed and empty ones give a row that says so; ids
    may be null or repeated; an empty table gives no rows; other columns are not
    read. Frames are decoded some at a time, and only their histograms are held.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CLIPS.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.string())
        for batch in batches:
            found = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            rows = [(d, *c) for d, raw in found if raw is not None for c in clips(raw)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    bounded_batches(media.sparkSession)
    return media.select(F.col("doc_id").cast("long"), F.col("media").cast("binary")).mapInArrow(cut, CLIPS)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0")


DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string())]
    + [("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)
DIGEST_DDL = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def media_digest(text: str | None) -> tuple:
    """Store a text as AVI, read it back, and describe both; a function of the text alone."""
    size, payload = payload_of(text)
    media = encode_avi(payload)
    frames, info = decode_avi(media)
    read = frames.tobytes()[: int(info["note"])]
    found = "|".join(f"{a / info['rate']:.2f}-{b / info['rate']:.2f}" for a, b in shots(frames))
    return (size, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-UNIT:]), len(media),
            hashlib.sha256(media).hexdigest(), f"{len(frames)} frames;{found}")


def store_texts(docs: DataFrame) -> DataFrame:
    """Media digest of every row's whole text.

    A null text counts as empty (64 zero bytes, one frame row); ids may be null
    or repeated; an empty table gives no rows; other columns are not read.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(media_digest, batch.column(1).to_pylist()), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(DIGEST)[1:], strict=True))],
                schema=DIGEST,
            )

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(store, DIGEST_DDL)
