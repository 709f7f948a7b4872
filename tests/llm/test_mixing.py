import re
from collections import Counter, defaultdict

import pytest

from driftwell.llm import mixing as M


def share(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: float((5, 2, 1)[i % 3]) for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        per = left / sum(weight[s] for s in free)
        over = [s for s in free if per * weight[s] > 2.0 * sizes[s]]
        if not over:
            return target | {s: per * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 1000}, {"a": 10}, {"a": 0, "b": 5}, {"z": 1, "y": 10**9, "x": 7, "w": 7}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in M.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(share(sizes))


def test_each_source_meets_its_target(docs):
    rows = M.mix(M.mix_keys(docs)).collect()
    taken, size, target = Counter(), Counter(), {}
    for r in rows:
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.source_size >= r.size
    assert target == pytest.approx(share(size))
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in size)


def test_complete_epochs_come_first(docs):
    epochs = defaultdict(set)
    for r in M.mix(M.mix_keys(docs)).collect():
        if r.size:
            epochs[r.source].add(r.taken // r.size)
            assert r.taken >= r.epochs * r.size
    assert any(max(v) >= 1 for v in epochs.values())


def test_same_as_sql(same):
    from driftwell.llm.registry import oracle_sql, queries

    same(queries()["op5_weighted_mix"], oracle_sql()["op5_weighted_mix"])


def test_slices_do_not_matter(docs, monkeypatch):
    show = lambda: sorted(map(repr, M.mix_documents(docs).collect()))
    many = show()
    monkeypatch.setattr(M, "SLICES", 2)
    assert show() == many


def test_quality_weighs_the_sample(spark):
    """Of two kinds of equal number, the one of higher weight is drawn more often."""
    rows = [(i, ("word " if i % 2 else "9999 ") * 10, "en", "s" if i < 4000 else f"t{i % 50}", 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = Counter()
    for r in M.mix(M.mix_keys(docs)).collect():
        if r.taken > r.epochs * r.size:
            more[r.doc_id % 2] += 1
    assert more[1] > 2 * more[0] > 0


def test_mixed_rows_hold_what_is_taken(docs):
    want = Counter()
    for r in M.mix(M.mix_keys(docs)).collect():
        want[r.doc_id, r.source] += r.taken
    got = Counter()
    for r in M.mixed_rows(docs).collect():
        got[r.doc_id, r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert +got == +want


def test_native(docs):
    assert "Python" not in M.mix_documents(docs)._jdf.queryExecution().toString()
