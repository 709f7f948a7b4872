import random

import pytest

from driftwell.llm import nearcopies as N
from driftwell.llm import simhash as S

SCHEMA = "doc_id long, text string"


def grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Smallest id of each group of rows linked by a 5-word Jaccard of 0.8 or more."""
    sets, up = [grams(t or "") for _, t in rows], list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or a and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


def corpus():
    r = random.Random(3)
    words = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    passage, out = words(50), []
    for _ in range(25):
        base = words(r.randint(20, 150))
        out.append(base)
        for _ in range(4):
            copy = list(r.choice(out[-3:]))
            for _ in range(r.randint(0, 4)):
                copy[r.randrange(len(copy))] = "edited"
            out.append(copy)
    out += [words(25) + passage for _ in range(25)]
    texts = [" ".join(x) for x in out] + ["", None, " ", "one two", "One  two", "one"]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("sampled", [1, 16])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, sampled):
    monkeypatch.setattr(N, "SAMPLED", sampled)
    rows = corpus()
    want = brute(rows)
    assert len(want) < len(rows) - 40
    assert sorted(r.doc_id for r in N.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()) == want


def test_near_copies_that_differ_in_more_bits(spark):
    r = random.Random(1)
    base = [f"w{r.randrange(5000)}" for _ in range(60)]
    texts = [" ".join(base), " ".join([*base, *"with quite a few more words than the first one".split()])]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    assert S.keep_one(df).count() == 2
    assert [x.doc_id for x in N.keep_one(df).collect()] == [0]


def test_empty(spark):
    assert N.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
