import math
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwell.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words, seen, dup = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit |= set(range(i, i + 5))
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


word = st.sampled_from(["a", "b", "é#", "x|y", "\n", " ", "\t", "\U0001f600"])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(word, max_size=40).map(" ".join), min_size=10, max_size=30))
def test_counts(spark, texts):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*texts, None])], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.text_statistics(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate([*texts, None])}


def test_tail_is_the_binomial_one(spark):
    cases = [(0, 10), (3, 100), (0, 5000), (12, 3000), (400, 40000)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", Q.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("t"))
    for r in df.collect():
        want = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(min(r.k, 60) + 1)) if r.n <= 5000 else None
        if want is not None:
            assert r.t == pytest.approx(want, rel=1e-6)
        else:
            assert 0.4 < r.t < 0.6


def corpus(spark, n, bad_labels):
    """Good prose and junk full of symbols; some good documents carry symbols too."""
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        dirty = not good or i % 997 == 1
        rows.append((i, " ".join(f"w{i}x{j}" + "###" * dirty for j in range(12)), "en" if i % 3 else "de", "s", 0))
        labels.append((i, int(good) if i % 11 else bad_labels, 0))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_cutoffs_reject_junk_within_the_risk(spark):
    docs, labels = corpus(spark, 16000, None)
    out = Q.judge(docs, labels).collect()
    wrong = [r for r in out if r.doc_id % 4 and not r.kept]
    assert all(not r.kept for r in out if r.doc_id % 4 == 0)
    assert 0 < len(wrong) <= Q.FALSE_REJECTION * len(out)


def test_too_few_labels_reject_nothing(spark):
    docs, labels = corpus(spark, 400, None)
    assert all(r.kept for r in Q.judge(docs, labels).collect())


@pytest.mark.parametrize(("n", "junk_stays"), [(400, True), (1400, False)])
def test_stage_needs_few_labels(spark, n, junk_stays):
    """A few hundred clean labels do, in a language of its own or in the pool."""
    docs, labels = corpus(spark, n, None)
    kept = {r.doc_id for r in Q.keep_good(docs, labels).collect()}
    assert {i for i in range(n) if i % 4} - kept <= {1, 998}
    assert (set(range(0, n, 4)) & kept == set(range(0, n, 4))) if junk_stays else not set(range(0, n, 4)) & kept


def test_stage_keeps_junk_that_labels_call_good(spark):
    docs, labels = corpus(spark, 16000, 1)
    assert Q.keep_good(docs, labels).count() == 16000


def test_labels_that_call_junk_good_forbid_the_cutoff(spark):
    docs, labels = corpus(spark, 16000, 1)
    assert all(r.kept for r in Q.judge(docs, labels).collect())


def test_same_as_sql(same):
    from driftwell.llm.registry import oracle_sql, queries

    same(queries()["op6_risk_controlled_rules"], oracle_sql()["op6_risk_controlled_rules"])


def test_a_long_text_of_repeats(spark):
    df = spark.createDataFrame([(1, "again " * 100_000, "en"), (2, " ".join(map(str, range(100_000))) + " 0 1 2 3 4", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.n_repeat_words for r in Q.text_statistics(df).collect()}
    assert got == {1: 100_000, 2: 10}


def test_native(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert "Python" not in Q.judge(docs, labels)._jdf.queryExecution().toString()
