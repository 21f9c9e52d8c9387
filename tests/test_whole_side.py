"""Queries on a side series read every event."""

import pytest

from barspan.plans.asof_queries import fund
from barspan.plans.catalog import ORACLES

NAMES = ("j03_asof_backward", "j04_asof_nearest", "j05_asof_shifted", "j06_interval_sum", "w14_side_features", "c16_side_profile", "a17_side_regimes")


def test_the_side_series_has_every_minute(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    want = {(r.event_type, r.ts.replace(second=0, microsecond=0)) for r in events.collect()}
    assert {(r.symbol, r.side_ts) for r in fund(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("name", NAMES)
def test_side_queries_filter_no_ids(name):
    assert "event_id %" not in ORACLES[name]
