import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwell.llm import substring as S


def brute(rows):
    """Rows in order of id (null last), then checksum; equal rows are one document."""
    import zlib

    order = sorted({(S.LAST_ID if d is None else d, zlib.crc32((t or "").encode()), t or "") for d, t, *_ in rows})
    seen, out = set(), {}
    for i, tag, text in order:
        words = S.split_words(text)
        gone = [False] * len(words)
        for p in range(len(words) - S.WINDOW + 1):
            window = tuple(words[p : p + S.WINDOW])
            if window in seen:
                gone[p : p + S.WINDOW] = [True] * S.WINDOW
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i, text] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return Counter((d, *out[S.LAST_ID if d is None else d, t or ""]) for d, t, *_ in rows)


def rows_of(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_as_brute_force(docs, prose):
    want = brute(prose)
    assert rows_of(S.remove_repeats(docs)) == want
    assert sum(k[2] * n for k, n in want.items()) > 1000


def test_equal_rows_are_one_document(spark, prose):
    """Also when they are the ones that are searched."""
    passage, words = prose[70][1], prose[10][1].split(" ")
    rows = [(5, f"{' '.join(words[:9])} {passage}"), (9, f"{' '.join(words[9:20])} {passage}")]
    df = spark.createDataFrame([*rows, *rows, (5, rows[1][1])], "doc_id long, text string")
    assert rows_of(S.remove_repeats(df)) == brute([tuple(r) for r in df.collect()])


def test_split_minimizers_give_the_same(docs, prose, monkeypatch):
    monkeypatch.setattr(S, "HOT", 2)
    monkeypatch.setattr(S, "SHARD_WORDS", 50)
    assert rows_of(S.remove_repeats(docs)) == brute(prose)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=200), st.integers(1, 6))
def test_index_finds_what_repeats(symbols, length):
    text = np.array([*symbols, 0], np.int64)
    index = S.FmIndex(text, length)
    ends = np.arange(length - 1, len(symbols))
    at, first = index.repeated(ends, length)
    seen, want = {}, {}
    for e in ends.tolist():
        seen.setdefault(tuple(symbols[e - length + 1 : e + 1]), []).append(e - length + 1)
    for places in seen.values():
        if len(places) > 1:
            want |= {p + length - 1: places[0] for p in places}
    assert dict(zip(at.tolist(), first.tolist(), strict=True)) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=300), st.data())
def test_ranks(symbols, data):
    a = np.array(symbols, np.int64)
    tree = S.WaveletMatrix(a, 4)
    at = np.array(data.draw(st.lists(st.integers(0, len(a)), min_size=1, max_size=20)), np.int64)
    for s in range(10):
        assert tree.rank(np.full(len(at), s), at).tolist() == [symbols[:i].count(s) for i in at.tolist()]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=20, max_size=120))
def test_equal_windows_share_their_segment_key(words):
    h, whole, start, n, weight = S._segments_of(words, S._Powers())
    key, content = {}, {}
    for k, x, s, m, w in zip(*(c.tolist() for c in (h, whole, start, n, weight)), strict=True):
        assert content.setdefault(x, words[s : s + m + 19]) == words[s : s + m + 19]
        windows = [tuple(words[p : p + 20]) for p in range(s, s + m)]
        assert len(set(windows)) == len(windows) or w == 2
        for v in windows:
            assert key.setdefault(v, k) == k
    assert sum(n.tolist()) == len(words) - 19
