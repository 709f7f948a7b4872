import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwell.llm import simhash as S


def naive(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", "É", "x ", "\t", "\n", "zz"]), max_size=30).map(" ".join))
def test_fingerprint(text):
    assert S.fingerprint(text) & (2**64 - 1) == naive(text)


def test_hash_is_sparks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("one two three four",)], "t string")
    assert df.select(F.xxhash64("t")).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("one two three four", 42)


def brute(fps):
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    u = np.array(sorted(up), np.int64)
    near = np.bitwise_count(u.view(np.uint64)[:, None] ^ u.view(np.uint64)[None]) <= S.LIMIT
    for i, j in zip(*np.nonzero(near), strict=True):
        up[root(int(u[i]))] = root(int(u[j]))
    groups = {}
    for f in up:
        groups.setdefault(root(f), set()).add(f)
    return sorted(map(sorted, groups.values()))


def clustered(n, seed):
    """Fingerprints that gather round a few centres, and chains of small steps."""
    r = random.Random(seed)
    centres, out = [r.getrandbits(64) for _ in range(6)], set()
    for _ in range(n):
        f = r.choice(centres)
        for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4, 5, 9])):
            f ^= 1 << b
        out.add(f)
    f = r.getrandbits(64)
    for _ in range(40):
        for b in r.sample(range(64), 4):
            f ^= 1 << b
        out.add(f)
    return [x - 2**64 if x >= 2**63 else x for x in out]


@pytest.mark.parametrize("block", [8192, 3])
def test_components_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    fps = clustered(120, block)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = S.near_links(df)
    groups = {f: {f} for f in fps}
    for node, root in S.components(links).collect():
        if node != root:
            groups.pop(node)
            groups[root].add(node)
    assert sorted(map(sorted, groups.values())) == brute(fps)
    assert links.count() < len(fps) * 13


def test_a_pair_within_the_limit_always_has_a_viable_chain():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**63, 4000).astype(np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << r.integers(0, 64, 4000).astype(np.uint64)
    assert np.any([S.viable(a, b, s) for s in range(5)], axis=0).all()


def test_rows(docs, prose):
    from collections import Counter

    fps = [S.fingerprint(t) for _, t, *_ in prose]
    least = {}
    for group in brute(fps):
        ids = [d for (d, *_), f in zip(prose, fps, strict=True) if f in group and d is not None]
        least |= {f: min(ids, default=None) for f in group}
    want = Counter((d, f"{f & (2**64 - 1):016x}", least[f]) for (d, *_), f in zip(prose, fps, strict=True))
    assert Counter(map(tuple, S.near_duplicates(docs).collect())) == want


def test_one_of_each_group_stays(docs, prose):
    kept = S.keep_one(docs).collect()
    assert len(kept) == len(brute([S.fingerprint(t) for _, t, *_ in prose]))
    assert len({S.fingerprint(r.text) for r in kept}) == len(kept)
