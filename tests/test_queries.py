"""Queries against their oracle on the smallest tables, and rules that hold for all of them."""

import os
import re
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entrypoint  # noqa: E402
from check import compare  # noqa: E402
from variantloom.fixtures import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
CHECKED = [
    "model_ready", "encode_features", "build_serving_features", "legacy_ui_features", "optimize_dataset", "feature_skew_report",
    "scan_annotation_tsv", "scan_vcf", "vcf_limit", "lookup_two_tier", "vcf_batch_score", "sink_csv_report", "category_lift",
    "schema_audit", "describe_numeric", "iqr_outliers", "class_separation", "threshold_sweep", "metrics_by_group",
    "stratified_split_exact", "counter_metrics", "distribution_drift", "alert_rules", "stream_latency_p95", "stream_score_variants",
    "quarantine_rows", "lookup_hot_requests", "alert_timeline", "dedupe_rows", "high_correlation_pairs", "target_statistics",
]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_oracle(spark, oracle, name):
    got = entrypoint.queries()[name](spark, SF).toPandas()
    assert compare(got, oracle.execute(entrypoint.oracle_sql()[name]).df()) == "ok"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_entry_returns_rows(spark):
    assert entrypoint.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entrypoint.oracle_sql()) <= set(entrypoint.queries())


def test_library_has_no_cross_joins_local_checkpoints_or_python_row_functions():
    forbidden = re.compile(r"crossJoin|localCheckpoint|toPandas\(|F\.udf\(|\.rdd\b|tempfile")
    for folder, _, files in os.walk(os.path.join(ROOT, "variantloom")):
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as handle:
                    found = forbidden.findall(handle.read())
                assert not found, (name, found)
