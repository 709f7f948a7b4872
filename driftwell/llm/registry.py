"""One query per operator, over whole tables, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import avi, html, mixing, packing, pii, quality, secrets, sharding, simhash, substring
from .common import documents

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    over = lambda f: lambda spark, sf_dir: f(documents(spark, sf_dir))
    return {
        "op1_minimum_bin_slack": over(packing.pack_documents),
        "op2_secret_linking": over(secrets.scan_secrets),
        "op3_avi_motion_jpeg": over(avi.store_texts),
        "op4_surrogates": over(pii.pii_rows),
        "op5_weighted_mix": over(mixing.mix_documents),
        "op6_risk_controlled_rules": lambda s, d: quality.judge(documents(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op7_fm_index": over(substring.remove_repeats),
        "op8_block_rules": lambda s, d: html.extract_pages(s.read.parquet(f"{d}/pages.parquet")),
        "op9_pigeonring": over(simhash.near_duplicates),
        "op10_hypergeometric_shards": over(sharding.shuffle_shards),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_weighted_mix": mixing.ORACLE, "op6_risk_controlled_rules": quality.ORACLE}
