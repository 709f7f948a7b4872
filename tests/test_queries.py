import pytest

import __spark_entry__
from driftwell.plans import registry

from .conftest import SMALL

WITH_SQL = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_as_sql(same, name):
    same(registry.queries()[name], registry.oracle_sql()[name])


def test_every_query_has_sql_or_its_own_test():
    assert set(registry.queries()) - set(WITH_SQL) == {"zstd_decode", "adaptive_batch_sizes"}


def test_entry_gives_one_row_per_key(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and len({r.key for r in rows}) == len(rows)


def test_a_position_bound_reaches_the_scan(spark, tmp_path):
    from driftwell.operators import cursors

    spark.range(100).selectExpr("concat(id, '-', id) AS stream_id", "id AS ms", "id AS seq").write.parquet(f"{tmp_path}/log")
    df = cursors.read_after(spark.read.parquet(f"{tmp_path}/log"), "40-40", 5)
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ms,40)" in plan
    assert [r.ms for r in df.collect()] == [41, 42, 43, 44, 45]


def test_latest_wins_aggregates_before_the_exchange(spark):
    plan = registry.latest_wins(spark, SMALL)._jdf.queryExecution().toString()
    assert "partial_max_by" in plan and "Python" not in plan
