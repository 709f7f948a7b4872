"""Row identity, one-word runs, and what the index itself answers."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwell.llm import substring as S

from .test_substring import brute, rows_of

#: Two words with one CRC-32.
SAME_CRC = ("uejgtcuo", "iiwucoup")


def test_texts_with_one_checksum_are_two_documents(spark, prose):
    a, b = prose[10][1].split(" ")[:19], prose[11][1].split(" ")[:25]
    texts = [" ".join([*a, w]) for w in SAME_CRC]
    assert len({zlib.crc32(t.encode()) for t in texts}) == 1
    long = [" ".join([*b, *a, w]) for w in SAME_CRC]
    rows = [(None, t) for t in (*texts, *long)] + [(4, t) for t in (*long, *long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = rows_of(S.remove_repeats(df))
    # Which of two texts with one id and checksum comes first is not stated, so sums are compared.
    assert sum(got.values()) == len(rows)
    words = lambda part: sum(k[2] * n for k, n in part.items())
    assert words(got) == words(brute(rows)) > 0


def test_tags_are_made_anew_until_they_differ(spark, docs, prose, monkeypatch):
    made = S._tag
    monkeypatch.setattr(S, "_tag", lambda text, seed: F.lit(0).cast("long") if seed < 2 else made(text, seed))
    assert rows_of(S.remove_repeats(docs)) == brute(prose)


@pytest.mark.parametrize("most", [20_000, 50])
def test_runs_of_one_word(spark, monkeypatch, most):
    monkeypatch.setattr(S, "HOT_WINDOWS", most)
    texts = [" ".join(["loop"] * n) for n in (20, 21, 300, 3000, 19)]
    texts += [f"start {texts[2]} {' '.join(map(str, range(30)))} {texts[2]}", " ".join(["ab", "cd"] * 200)]
    rows = list(enumerate(texts)) + [(None, texts[3])]
    assert rows_of(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_long_runs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_WINDOWS", 50)
    df = spark.createDataFrame([(i, " ".join(["loop"] * (100 + i))) for i in range(5)], "doc_id long, text string")
    searched, _ = S._candidates(S.tagged(df))
    assert [r.hot for r in searched.select("hot").distinct().collect()] == [True]


def test_the_index_decides_what_it_is_asked(monkeypatch):
    """Texts that share a passage but no whole segment lose nothing if the index finds nothing."""
    segments = [(1, 0, 0, " ".join(map(str, range(40)))), (2, 0, 0, " ".join(map(str, range(5, 50))))]
    assert S.search_shard(segments) == [(2, 0, 0, 16)]
    monkeypatch.setattr(S.FmIndex, "repeated", lambda self, ends, length: (ends[:0], ends[:0]))
    assert S.search_shard(segments) == []


def test_spans_and_kept_text(docs, prose):
    found = Counter()
    for r in S.cleaned(docs).collect():
        assert len(r.kept.split(" ") if r.kept else []) == r.n_words - r.n_removed
        assert sum(s.n for s in r.spans) == r.n_removed and all(s.n >= S.WINDOW for s in r.spans)
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
        found[r.doc_id, r.n_words, r.n_removed, r.kept_sha256] += 1
    assert found == brute(prose)


SYMBOLS = st.lists(st.integers(1, 4), min_size=1, max_size=150)


@settings(max_examples=40, deadline=None)
@given(SYMBOLS, st.integers(1, 9))
def test_matching_statistics(symbols, limit):
    text = np.array([*symbols, 0], np.int64)
    ends = np.arange(min(limit, len(symbols)) - 1, len(symbols))
    limit = int(ends[0]) + 1
    got, low, high = S.FmIndex(text, limit).matching(ends, limit)
    for e, length, a, b in zip(ends.tolist(), got.tolist(), low.tolist(), high.tolist(), strict=True):
        times = lambda m: sum(symbols[i : i + m] == symbols[e - m + 1 : e + 1] for i in range(len(symbols) - m + 1))  # noqa: B023, E731
        assert length == max([m for m in range(1, limit + 1) if times(m) > 1], default=0)
        assert not length or b - a == times(length)


@settings(max_examples=40, deadline=None)
@given(SYMBOLS)
def test_places_come_from_the_samples(symbols):
    text = np.array([*symbols, 0], np.int64)
    order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    assert S.suffix_order(text).tolist() == order
    assert S.FmIndex(text, 3).places(np.arange(len(text))).tolist() == order
    assert len(S.FmIndex(text, 3).samples) == -(-len(text) // 8)
