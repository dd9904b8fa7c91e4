"""A cross-section of registered queries against their check SQL; tools/check.py runs all."""

import duckdb
import pytest

from check import TABLES, compare

SF = "/root/testdata/sf0.001"
NAMES = [
    "pooled_and_grouped_metrics",
    "lovasz_per_frame",
    "roc_auc",
    "peak_and_final",
    "width_of_nearest_ridge",
    "matched_ab",
    "z_buffer",
    "target_fraction_repeat",
    "split_within_source",
    "leak_verdicts",
    "stream_new_evals",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    from pixelmill.plans import REGISTRY

    q = REGISTRY[name]
    note, ok = compare(name, q.run(spark, SF), con, q.sql)
    assert ok, note


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 24
