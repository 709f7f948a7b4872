import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwell.llm import avi as A


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_payloads_come_back(raw):
    payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
    frames, info = A.decode_avi(A.encode_avi(payload))
    assert frames.tobytes()[: int(info["note"])] == payload


def test_frames_decode_one_by_one_and_without_an_index():
    payload = bytes(range(256)) * 40
    raw = A.encode_avi(payload)
    frames, info = A.decode_avi(raw)
    assert np.array_equal(np.stack([A.decode_frame(raw[a:b]) for a, b in info["spans"]]), frames)
    at = raw.index(b"idx1")
    assert A.parse_avi(raw[:at])["spans"] == info["spans"]
    assert info["rate"] == 25


def test_a_general_huffman_table():
    """A lossless frame with an ordinary table, bit by bit."""
    samples = np.random.default_rng(3).integers(0, 256, (5, 9)).astype(np.int64)
    counts, symbols = bytes([0, 1, 5, 1, 1, 1, *[0] * 10]), bytes(range(9))
    codes = {s: k for k, s in A._codes(counts, symbols).items()}
    bits = ""
    for y in range(5):
        for x in range(9):
            d = int(samples[y, x] - (samples[y, x - 1] if x else samples[y - 1, 0] if y else 128))
            n = abs(d).bit_length()
            width, code = codes[n]
            bits += f"{code:0{width}b}" + (f"{d if d > 0 else d + (1 << n) - 1:0{n}b}" if n else "")
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big").replace(b"\xff", b"\xff\0")
    head = b"\xff\xd8" + A._segment(A.LOSSLESS, b"\x08\0\x05\0\x09\x01\x01\x11\0") + A._segment(A.DHT, b"\0" + counts + symbols)
    assert np.array_equal(A.decode_frame(head + A._segment(A.SOS, b"\x01\x01\0\x01\0\0") + data + b"\xff\xd9"), samples)


def baseline(image, quant):
    """A baseline frame of one table, coded naively."""
    c, z = A.cosines(), A.zigzag()
    rows, cols = image.shape[0] // 8, image.shape[1] // 8
    counts = bytes([0] * 7 + [255] + [0] * 8)  # every symbol has eight bits
    bits, last = "", 0
    sign = lambda v, n: f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""
    for y in range(rows):
        for x in range(cols):
            block = image[8 * y : 8 * y + 8, 8 * x : 8 * x + 8].astype(float) - 128
            q = np.rint((c @ block @ c.T).ravel()[z] / quant).astype(int)
            n = abs(int(q[0]) - last).bit_length()
            bits += f"{n:08b}" + sign(int(q[0]) - last, n)
            last, run = int(q[0]), 0
            for k in range(1, 64):
                if not q[k:].any():
                    bits += f"{0:08b}"
                    break
                if q[k] == 0:
                    run += 1
                    if run == 16:
                        bits, run = bits + f"{0xF0:08b}", 0
                    continue
                n = abs(int(q[k])).bit_length()
                bits, run = bits + f"{run << 4 | n:08b}" + sign(int(q[k]), n), 0
    size = -(-len(bits) // 8)
    data = int(bits.ljust(size * 8, "1"), 2).to_bytes(size, "big").replace(b"\xff", b"\xff\0")
    table = counts + bytes(range(255))
    h, w = image.shape
    return (b"\xff\xd8" + A._segment(A.DQT, b"\0" + bytes(quant.tolist())) + A._segment(A.BASELINE, bytes([8, 0, h, 0, w, 1, 1, 0x11, 0]))
            + A._segment(A.DHT, b"\0" + table + b"\x10" + table) + A._segment(A.SOS, b"\x01\x01\0\0\x3f\0") + data + b"\xff\xd9")


def test_baseline_frames_decode_to_what_was_coded():
    y, x = np.mgrid[0:16, 0:24]
    image = (128 + 60 * np.sin(x / 5) + 40 * np.cos(y / 3)).astype(np.uint8)
    fine = A.decode_frame(baseline(image, np.ones(64, int)))
    assert np.abs(fine.astype(int) - image).max() <= 1
    coarse = A.decode_frame(baseline(image, np.full(64, 16)))
    assert np.abs(coarse.astype(int) - image).mean() < 6
    frames, _ = A.decode_avi(A.mux_avi([baseline(image, np.ones(64, int))] * 3, 24, 16))
    assert frames.shape == (3, 16, 24)


def test_zigzag_order():
    assert A.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(A.zigzag()) == list(range(64))


def test_shots_cut_where_the_picture_changes():
    r = np.random.default_rng(1)
    dark, light = r.integers(0, 60, (8, 16, 64)), r.integers(180, 250, (6, 16, 64))
    frames = np.concatenate([dark, light, dark[:3]]).astype(np.uint8)
    assert A.shots(frames) == [(0, 8), (8, 14), (14, 17)]
    assert A.shots(frames[:1]) == [(0, 1)] and A.shots(frames[:0]) == []


def test_clip_rows(spark):
    r = np.random.default_rng(1)
    frames = np.concatenate([r.integers(0, 60, (5, 16, 64)), r.integers(180, 250, (5, 16, 64))]).astype(np.uint8)
    df = spark.createDataFrame([(1, A.encode_avi(frames.tobytes())), (2, None)], "doc_id long, media binary")
    got = A.avi_clips(df).orderBy("clip").collect()
    assert [(r.doc_id, r.first_frame, r.end_frame, r.start_s, r.end_s) for r in got] == [(1, 0, 5, 0.0, 0.2), (1, 5, 10, 0.2, 0.4)]


def test_rows(docs, prose):
    want = {t: (len(b := (t or "").encode()), b.ljust(max(1, -(-len(b) // 64)) * 64, b"\0")) for _, t, *_ in prose}
    by_text = {}
    for r in A.store_texts(docs).join(docs.filter("doc_id < 80 AND doc_id NOT IN (3, 7)").select("doc_id", "text"), "doc_id").collect():
        n, payload = want[r.text]
        assert (r.n_bytes, r.payload_bytes) == (n, len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert by_text.setdefault(r.text, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
