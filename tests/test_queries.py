"""Registered queries against their SQL twins on the smallest data folder."""

import os

import pytest

import __spark_entry__ as entry_module
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "event_study", "car_ttest", "bootstrap_ci", "join_pit_topn", "join_mark_lookback", "resample_bars", "percentile_rank",
    "pead_signal", "trade_metrics", "render_snapshot_blind", "validate_answer", "run_history", "validate_book",
    "order_sequence", "daily_nav", "cash_ledger", "rebalanced_nav", "answers_by_content", "answer_runs", "assess_report", "event_study_limited",
    "event_daily_path", "daily_nav_tolerant", "unpriced_stretches", "basket_marks", "quarantined_receipts", "last_run_per_fund", "car_bars",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")


def test_every_query_has_a_twin_with_the_same_name():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(CHOSEN) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", CHOSEN)
def test_parity(spark, name):
    ok, note = compare(spark, connect(FOLDER), FOLDER, name, entry_module.queries(), entry_module.oracle_sql())
    assert ok, note


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 275 and df.columns[:3] == ["filing_id", "ticker", "filing_date"]
