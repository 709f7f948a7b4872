from collections import Counter

import pytest

import corpus_pipeline as C
from driftwell.llm import pii, quality, simhash

from ..conftest import SMALL


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What every stage gets and gives, each written and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for i, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{i}")
        out.append((name, docs, spark.read.parquet(f"{folder}/{i}")))
        docs = out[-1][2]
    return out


def test_columns(steps):
    assert [n for n, *_ in steps] == ["quality rules", "near-duplicates", "personal data", "source mix", "packing"]
    for _, _, after in steps[:-1]:
        assert after.columns == list(C.COLUMNS)
    assert "sequence_id" in steps[-1][2].columns


def test_quality_stage(spark, steps):
    _, before, after = steps[0]
    verdict = quality.judge(before, spark.read.parquet(f"{SMALL}/labels.parquet"))
    want = {r.doc_id for r in verdict.filter("kept").collect()}
    assert {r.doc_id for r in after.collect()} == want and len(want) < before.count()
    assert after.join(before, list(C.COLUMNS), "left_anti").count() == 0


def test_near_duplicate_stage(steps):
    _, before, after = steps[1]
    named = simhash.near_duplicates(before).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted({r.component_id for r in named})
    assert after.count() < before.count()


def test_personal_data_stage(steps):
    _, before, after = steps[2]
    texts = {r.doc_id: r.text for r in after.collect()}
    changed = 0
    for r in before.collect():
        if texts[r.doc_id] != r.text:
            changed += 1
    assert 0 < changed < before.count() == len(texts)
    found = pii.pii_rows(before).filter("n_email > 0").count()
    assert found and after.filter("text RLIKE '@mail[0-9]+[.]example[.]com'").count() == 0


def test_mix_stage(steps):
    _, before, after = steps[3]
    sizes = Counter()
    for r in before.collect():
        sizes[r.source] += len(r.text.split())
    got = Counter()
    for r in after.collect():
        got[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.01)


def test_packing_stage(steps):
    _, before, after = steps[4]
    assert after.agg({"length": "sum"}).first()[0] > before.count()
    assert after.filter("start = 0").count() == before.count()


def test_run_gives_what_the_stages_give(spark, steps):
    rows = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert rows(C.run(spark, SMALL)) == rows(steps[-1][2])
