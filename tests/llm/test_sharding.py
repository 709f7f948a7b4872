import random
import zlib
from collections import Counter, defaultdict
from math import comb

import pytest

from driftwell.llm import sharding as S


def test_draws_follow_the_law():
    rng, n = random.Random(1), 20000
    seen = Counter(S.hypergeometric(rng, 7, 5, 6) for _ in range(n))
    for k in range(1, 7):
        assert seen[k] / n == pytest.approx(comb(7, k) * comb(5, 6 - k) / comb(12, 6), abs=0.015)
    big = [S.hypergeometric(rng, 6 * 10**9, 10**10, 10**6) for _ in range(50)]
    assert sum(big) / 50 == pytest.approx(375_000, rel=0.001)
    assert S.hypergeometric(rng, 0, 5, 3) == 0 and S.hypergeometric(rng, 5, 0, 3) == 3


def test_matrix_sums():
    sizes = [100, 0, 37, 1]
    m = S.communication_matrix(sizes, 16, 3)
    assert [sum(r) for r in m] == sizes
    totals = [sum(c) for c in zip(*m, strict=True)]
    assert max(totals) - min(totals) <= 1 and sum(totals) == 138


def test_rows(docs, prose):
    rows = S.shuffle_shards(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in prose
    )
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_blocks_of_a_shard_join_without_gaps(docs, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 2)
    slots = defaultdict(list)
    for r in S.shuffle_shards(docs).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_the_shuffle_is_uniform_and_repeatable(spark):
    docs = spark.range(0, 8000, 1, 8).selectExpr("id AS doc_id", "'x' AS text")
    rows = [(r.doc_id, r.shard, r.slot) for r in S.shuffle_shards(docs).collect()]
    assert sorted(rows) == sorted((r.doc_id, r.shard, r.slot) for r in S.shuffle_shards(docs).collect())
    cells = Counter((d // 1000, s) for d, s, _ in rows)  # 62.5 expected in each of 128
    chi = sum((cells[p, s] - 62.5) ** 2 / 62.5 for p in range(8) for s in range(16))
    assert 60 < chi < 160
    places = [slot for d, _, slot in rows if d < 1000]
    assert sum(places) / 1000 == pytest.approx(249.5, abs=15)
    assert rows != sorted(rows)
