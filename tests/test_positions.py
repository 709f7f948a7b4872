from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwell.functions import positions as P

MOST = 2**64 - 1


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "a string, b string")


def number(text):
    digits = text[1:] if text[:1] == "+" else text
    return int(digits) if digits.isascii() and digits.isdigit() and int(digits) <= MOST else 0


def model(text):
    parts = text.split("-")
    return (number(parts[0]), number(parts[1])) if len(parts) == 2 else (number(text), 0)


def test_orders_as_numbers(spark):
    pairs = [("1000-99", "1000-100"), ("0", "1000-0"), ("0", "0"), ("9999999999999999-0", "10000000000000000-0")]
    got = [r.c for r in rows(spark, pairs).select(P.compare(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [-1, -1, 0, -1]


def test_lag(spark):
    pairs = [("1000000000000-0", "1000000005000-0"), ("5-0", "5-9"), ("9-0", "5-0"), ("0", "5-0"), ("5-0", "invalid"), (None, "5-0")]
    got = [r.c for r in rows(spark, pairs).select(P.lag_ms(F.col("a"), F.col("b")).cast("long").alias("c")).collect()]
    assert got == [5000, 0, 0, None, None, None]


part = st.one_of(st.integers(0, 2**65).map(str), st.sampled_from(["", "x", " 5", "5.7", "+3", "-1"]))
ids = st.one_of(part, st.tuples(part, part).map("-".join), st.tuples(part, part, part).map("-".join))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(ids, ids), min_size=20, max_size=40))
def test_agrees_with_a_model_and_is_antisymmetric(spark, pairs):
    a, b = F.col("a"), F.col("b")
    found = rows(spark, pairs).select("a", "b", P.compare(a, b).alias("c"), P.compare(b, a).alias("d")).collect()
    for r in found:
        x, y = model(r.a), model(r.b)
        assert r.c == (x > y) - (x < y) == -r.d
