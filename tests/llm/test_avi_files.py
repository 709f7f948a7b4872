"""Frames and files other programs write: colour, restarts, standard tables, OpenDML, damage."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwell.llm import avi as A


def coder(table):
    counts, symbols = (bytes.fromhex(x) for x in A.STANDARD[table])
    return {s: f"{code:0{width}b}" for (width, code), s in A._codes(counts, symbols).items()}


def extra(v):
    n = abs(v).bit_length()
    return f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""


def stuffed(bits):
    size = -(-len(bits) // 8)
    return int(bits.ljust(size * 8, "1") or "0", 2).to_bytes(size, "big").replace(b"\xff", b"\xff\0")


def block(pixels, last, number):
    dc, ac = coder(number), coder(0x10 | number)
    c = A.cosines()
    q = np.rint((c @ (pixels.astype(float) - 128) @ c.T).ravel()[A.zigzag()]).astype(int).tolist()
    out, run = dc[abs(q[0] - last).bit_length()] + extra(q[0] - last), 0
    for k in range(1, 64):
        if not any(q[k:]):
            return out + ac[0], q[0]
        if not q[k]:
            run += 1
            if run == 16:
                out, run = out + ac[0xF0], 0
            continue
        out, run = out + ac[run << 4 | abs(q[k]).bit_length()] + extra(q[k]), 0
    return out, q[0]


def colour(planes, sampling, restart=0):
    """A colour frame of the standard tables without DHT, coded naively; planes fill whole units."""
    height, width = planes[0].shape
    down, across = sampling
    pieces, bits, last, unit = [], "", [0, 0, 0], 0
    for y in range(0, height, 8 * down):
        for x in range(0, width, 8 * across):
            if restart and unit and unit % restart == 0:
                pieces, bits, last = [*pieces, stuffed(bits)], "", [0, 0, 0]
            for j in range(down):
                for i in range(across):
                    more, last[0] = block(planes[0][y + 8 * j :, x + 8 * i :][:8, :8], last[0], 0)
                    bits += more
            for k in (1, 2):
                more, last[k] = block(planes[k][y // down :, x // across :][:8, :8], last[k], 1)
                bits += more
            unit += 1
    pieces.append(stuffed(bits))
    data = pieces[0] + b"".join(bytes((0xFF, 0xD0 + n % 8)) + p for n, p in enumerate(pieces[1:]))
    parts = bytes([1, across << 4 | down, 0, 2, 0x11, 0, 3, 0x11, 0])
    return (b"\xff\xd8" + A._segment(A.DQT, b"\0" + b"\1" * 64) + (A._segment(A.DRI, struct.pack(">H", restart)) if restart else b"")
            + A._segment(A.BASELINE, struct.pack(">BHHB", 8, height, width, 3) + parts)
            + A._segment(A.SOS, b"\3\1\0\2\x11\3\x11\0\x3f\0") + data + b"\xff\xd9")


def picture(height, width, phase=0.0):
    y, x = np.mgrid[0:height, 0:width]
    return (128 + 60 * np.sin(x / 5 + phase) + 40 * np.cos(y / 3)).astype(np.uint8)


@pytest.mark.parametrize("sampling", [(1, 1), (1, 2), (2, 2)])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_colour_frames(sampling, restart):
    down, across = sampling
    planes = [picture(32, 48), picture(32 // down, 48 // across, 1), picture(32 // down, 48 // across, 2)]
    got = A.decode_planes(colour(planes, sampling, restart))
    for found, want in zip(got, planes, strict=True):
        whole = want.repeat(32 // want.shape[0], axis=0).repeat(48 // want.shape[1], axis=1)
        assert found.shape == (32, 48) and np.abs(found.astype(int) - whole).max() <= 1


def test_standard_tables_hold_every_symbol_once():
    for table, (counts, symbols) in A.STANDARD.items():
        found = bytes.fromhex(symbols)
        want = {0, 0xF0} | {r << 4 | n for r in range(16) for n in range(1, 11)} if table >> 4 else set(range(12))
        assert sum(bytes.fromhex(counts)) == len(found) == len(set(found)) and set(found) == want


def lossless(samples, predictor, restart, shift):
    """A lossless frame by the standard's formulas, sample by sample."""
    height, width = samples.shape
    s, pieces, bits, table = (samples >> shift).astype(int), [], "", coder(0x00)
    for y in range(height):
        top = y == 0 or (restart and y * width % restart == 0)
        if top and y:
            pieces, bits = [*pieces, stuffed(bits)], ""
        for x in range(width):
            a, b, c = (s[y, x - 1] if x else 0), (s[y - 1, x] if y else 0), (s[y - 1, x - 1] if x and y else 0)
            if top:
                guess = a if x else 128 >> shift
            elif not x:
                guess = b
            else:
                guess = [a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1][predictor - 1]
            d = int(s[y, x] - guess)
            bits += table[abs(d).bit_length()] + extra(d)
    pieces.append(stuffed(bits))
    data = pieces[0] + b"".join(bytes((0xFF, 0xD0 + n % 8)) + p for n, p in enumerate(pieces[1:]))
    return (b"\xff\xd8" + A._segment(A.LOSSLESS, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0)) + A._segment(A.DRI, struct.pack(">H", restart))
            + A._segment(A.SOS, bytes((1, 1, 0, predictor, 0, shift))) + data + b"\xff\xd9")


@pytest.mark.parametrize("predictor", range(1, 8))
@pytest.mark.parametrize(("restart", "shift"), [(0, 0), (18, 0), (0, 2)])
def test_lossless_predictors(predictor, restart, shift):
    samples = np.random.default_rng(predictor).integers(0, 256, (7, 9))
    got = A.decode_frame(lossless(samples, predictor, restart, shift))
    assert np.array_equal(got, samples >> shift << shift)


def frames(n):
    return A._frames(np.random.default_rng(n).integers(0, 256, (n, 16, 64)).astype(np.uint8))


def test_further_parts_and_groups_are_walked():
    first, rest = frames(3), frames(4)
    grouped = A._list(b"rec ", b"".join(A._chunk(b"00dc", f) for f in rest[:2]) + A._chunk(b"01wb", b"sound"))
    further = A._chunk(b"RIFF", b"AVIX" + A._list(b"movi", grouped + b"".join(A._chunk(b"00dc", f) for f in rest[2:])))
    raw = A.mux_avi(first, 64, 16) + further
    assert [raw[a:b] for a, b in A.parse_avi(raw)["spans"]] == first + rest
    assert A.decode_avi(raw)[0].shape == (7, 16, 64)


def test_opendml_indexes_are_followed():
    """One index chunk for two lists; a chunk no index names is not a frame."""
    named, hidden = frames(3), frames(5)[4]
    stream = A._chunk(b"strh", struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", *[0] * 4, 1, 10, *[0] * 9))
    inside, places = A._chunk(b"00dc", hidden), []
    for f in named:
        places.append((len(inside) + 8, len(f)))
        inside += A._chunk(b"00dc", f)

    def file(base, at):
        entries = b"".join(struct.pack("<II", *p) for p in places)
        index = A._chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(named), b"00dc", base, 0) + entries)
        top = A._chunk(b"indx", struct.pack("<HBBI4s12x", 4, 0, 0, 1, b"00dc") + struct.pack("<QII", at, len(index), 0))
        head = A._list(b"hdrl", A._list(b"strl", stream + top))
        raw = A._chunk(b"RIFF", b"AVI " + head + A._list(b"movi", inside + index))
        return raw, raw.index(inside), raw.index(b"ix00")

    _, base, at = file(0, 0)
    raw = file(base, at)[0]
    info = A.parse_avi(raw)
    assert [raw[a:b] for a, b in info["spans"]] == named and info["rate"] == 10


def test_empty_and_damaged_frames_show_the_one_before():
    good = frames(4)
    mixed = [good[0], b"", good[1][:40], good[2], b"\xff\xd8nothing", good[3]]
    rows = A.clips(A.mux_avi(mixed, 64, 16))
    assert rows[-1][2] == 6 and {r[-1] for r in rows} == {"2 damaged frames"}
    whole = A.clips(A.mux_avi([good[0], b"", good[1]], 64, 16))
    assert whole[-1][2] == 3 and whole[0][-1] == "ok"
    with pytest.raises(ValueError):
        A.decode_avi(A.mux_avi(mixed, 64, 16))


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_damage_never_raises(data):
    r = A.mux_avi([colour([picture(16, 16)] + [picture(16, 16)] * 2, (1, 1), 2), *frames(2)], 64, 16)
    raw = bytearray(r)
    for _ in range(data.draw(st.integers(1, 12))):
        raw[data.draw(st.integers(0, len(raw) - 1))] = data.draw(st.integers(0, 255))
    raw = bytes(raw)[: data.draw(st.integers(0, len(raw)))]
    rows = A.clips(raw)
    assert rows and all(x[-1] for x in rows)


def test_status_rows(spark):
    df = spark.createDataFrame(
        [(1, b""), (2, b"garbage"), (3, A.mux_avi([], 64, 16)), (4, None), (None, A.mux_avi(frames(1), 64, 16))], "doc_id long, media binary"
    )
    got = {r.doc_id: (r.clip, r.status) for r in A.avi_clips(df).collect()}
    assert set(got) == {1, 2, 3, None} and got[None] == (0, "ok")
    assert all(got[i][0] is None and got[i][1].startswith("not decoded") for i in (1, 2, 3))
    assert A.avi_clips(df.limit(0)).count() == 0
