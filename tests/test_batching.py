import random

import pytest

from driftwell.operators import batching, repair

CHANGE = "peer_id string, op string, key string, hash string, data binary, ms long, seq long, extra string"


def closings(rows, max_keys, timeout):
    """The rule read change by change, peer by peer."""
    out, of = [], {}
    for r in sorted(rows, key=lambda r: (r[0] or "", r[5], r[6])):
        of.setdefault(r[0], []).append(r)
    for peer, changes in of.items():
        batch, keys = [], set()
        for r in changes:
            if batch and r[5] - batch[0][0] >= timeout:
                out.append((peer, *batch[0], *batch[-1], len(batch), len(keys), False))
                batch, keys = [], set()
            batch.append((r[5], r[6]))
            if r[1] == "DELETE" or r[3] is not None and r[4] is not None:
                keys.add(r[2])
            if len(keys) >= max_keys:
                out.append((peer, *batch[0], *batch[-1], len(batch), len(keys), True))
                batch, keys = [], set()
        if batch:
            out.append((peer, *batch[0], *batch[-1], len(batch), len(keys), False))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_keys, timeout", [(1, 1), (3, 50), (100, 7), (2, 100_000)])
def test_batches_close_as_the_rule_says(spark, max_keys, timeout):
    rng, rows, ms = random.Random(max_keys), [], 0
    for seq in range(600):
        ms += rng.choice((0, 1, 3, 20, 60, 300_000))
        peer = rng.choice(("a", "a", "b", None))
        op = rng.choice(("PUT", "PUT", "DELETE"))
        rows.append((peer, op, f"k{rng.randrange(6)}", rng.choice(("h", None)), b"", ms, seq, "x"))
    got = batching.batches(spark.createDataFrame(rows, CHANGE).repartition(7), "peer_id", max_keys, timeout).collect()
    plain = [tuple(int(v) if type(v).__name__ == "Decimal" else v for v in r) for r in got]
    assert sorted(plain, key=repr) == closings(rows, max_keys, timeout)


def test_no_changes_no_batches(spark):
    assert batching.batches(spark.createDataFrame([], CHANGE), "peer_id", 3, 50).count() == 0
    with pytest.raises(ValueError):
        batching.batches(spark.createDataFrame([], CHANGE), "peer_id", 0, 50)


def test_a_budget_is_cut_before_the_exchange(spark):
    diffs = spark.range(100).selectExpr("concat('p', id % 2) AS peer_id", "concat('k', id) AS key", "IF(id % 3 = 0, 'delete', 'fetch') AS action")
    df = repair.budgeted_by_peer(diffs, 5)
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()
    assert sorted(r.key for r in df.collect()) == sorted(f"k{i}" for i in range(100) if i % 2 == 0 and i % 3)[:5]
