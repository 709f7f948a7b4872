import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftwell.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=5), st.integers(0, 40))
def test_fills_as_closely_as_any_multiset(counts, room):
    items = [k for k, n in counts.items() for _ in range(n)]
    best = max(s for n in range(len(items) + 1) for c in combinations(items, n) if (s := sum(c)) <= room)
    found = dict(P.best_fill(counts, room))
    assert sum(k * n for k, n in found.items()) == best
    assert all(n <= counts[k] for k, n in found.items())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 1000), max_size=20))
def test_plans_use_every_length_once(counts):
    plan, used = P.plan_patterns(counts, 64), Counter()
    for repeats, pattern in plan:
        assert repeats > 0 and sum(k * n for k, n in pattern) <= 64
        for k, n in pattern:
            used[k] += repeats * n
    assert used == Counter(counts)


def test_the_cached_tokenizer_is_the_tokenizer():
    plain, cached = Tokenizer.from_file(P.default_tokenizer()), P.WordTokenizer(P.default_tokenizer())
    assert cached.cached
    texts = ["It's CAFÉ don'T We'LL", "'ss ''s ##'s a_b 12²½ ÿŸ", "<|startoftext|>a", "İ Σ ΑΣ", "", "\x1c \x85\xa0x", "日本 тест", "word " * 50]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert cached.encode(texts) == want == cached.encode(texts)


def test_every_id_lies_in_one_place(docs, prose):
    plain = Tokenizer.from_file(P.default_tokenizer())
    rows = P.pack_documents(docs).collect()
    want = Counter()
    for doc, text, *_ in prose:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        for start in range(0, len(ids), 4096):
            part = ids[start : start + 4096]
            want[doc, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) == -(-sum(r.length for r in rows) // 4096)


def test_counts_beyond_the_broadcast_bound_are_joined(docs, monkeypatch):
    show = lambda df: sorted(map(repr, df.collect()))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = P.pack_documents(docs)
    monkeypatch.setattr(P, "SENT", 0)
    docs.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    many = P.pack_documents(docs)
    assert "BroadcastHashJoin" in plan(few) and "BroadcastHashJoin" not in plan(many)
    assert show(few) == show(many)
    docs.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_full_cache_starts_over(monkeypatch):
    plain = Tokenizer.from_file(P.default_tokenizer())
    monkeypatch.setattr(P, "MEMORY", 2000)
    monkeypatch.setattr(P, "STEP", 3)
    cached = P.WordTokenizer(P.default_tokenizer())
    texts = [f"alpha{i} beta{i} gamma {'delta ' * i} omega" for i in range(20)]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert cached.encode(texts) == want and cached.held < 6000
