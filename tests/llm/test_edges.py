"""Nulls, empty tables, clashing names and repeated rows, for every operator."""

import pytest
from pyspark.sql import functions as F

from driftwell.llm import avi, html, mixing, packing, pii, quality, secrets, sharding, simhash, substring

LABELS = "doc_id long, quality int, toxic int"


def judge(df):
    return quality.judge(df, df.sparkSession.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 0), (2, None, 0), (999, 1, 0)], LABELS))


def extract(df):
    return html.extract_pages(df.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html")))


OPERATORS = [
    packing.pack_documents, secrets.scan_secrets, avi.store_texts, pii.pii_rows, mixing.mix_documents, judge,
    substring.remove_repeats, extract, simhash.near_duplicates, sharding.shuffle_shards,
]


@pytest.mark.parametrize("operator", OPERATORS)
def test_empty_table(operator, docs):
    assert operator(docs.filter("false")).collect() == []


@pytest.mark.parametrize("operator", [o for o in OPERATORS if o is not extract])
def test_extra_columns_do_not_matter(operator, docs, clashing):
    places = {"sequence_id", "offset", "shard", "slot"}  # depend on how rows lie in partitions
    show = lambda df: sorted(map(repr, df.select(*[c for c in df.columns if c not in places]).collect()))
    got = show(operator(clashing))
    assert got == show(operator(docs)) and len(got) >= docs.count()


@pytest.mark.parametrize("operator", OPERATORS)
def test_a_row_of_nulls(operator, docs):
    assert len(operator(docs.filter("doc_id IS NULL AND text IS NULL")).collect()) == 1


def test_stages_keep_all_columns(clashing):
    labels = clashing.sparkSession.createDataFrame([], LABELS)
    kept = (quality.keep_good(clashing, labels), simhash.keep_one(clashing), mixing.mixed_rows(clashing))
    for out in (*kept, pii.replace_entities(clashing.drop("pii")).drop("pii")):
        assert set(clashing.columns) - {"pii"} <= set(out.columns)
        assert {r[0] for r in out.select("start").collect()} == {r[0] for r in out.select("__row").collect()} == {"clash"}
