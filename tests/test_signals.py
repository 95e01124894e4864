from datetime import date, timedelta

import pytest

from panelmill.operators import signals
from panelmill.operators.series import onset, rebalance_days, relative_strength, resample_curve

FILING = "filing_id BIGINT, ticker STRING, filing_date DATE, report_period DATE, source_type STRING, eps_surprise STRING"
JUNE = date(2025, 6, 30)


def ask(spark, filings, *days, **kw):
    f = spark.createDataFrame([(i, "T", *row) for i, row in enumerate(filings)], FILING)
    grid = spark.createDataFrame([("T", d) for d in days], "ticker STRING, date DATE")
    return {r.date: r.value for r in signals.surprise_signal(grid, f, **kw).collect()}


def test_fresh_stale_future_and_weekend(spark):
    got = ask(spark, [(date(2025, 8, 2), JUNE, "8-K", "BEAT")], date(2025, 8, 1), date(2025, 8, 4), date(2025, 8, 6),
              date(2025, 8, 7), date(2025, 9, 1))
    assert list(got.values()).count(1.0) == 2
    assert got == {date(2025, 8, 1): 0.0, date(2025, 8, 4): 1.0, date(2025, 8, 6): 1.0, date(2025, 8, 7): 0.0, date(2025, 9, 1): 0.0}


def test_miss_meet_late_and_source_rules(spark):
    d = date(2025, 8, 1)
    assert ask(spark, [(d, JUNE, "8-K", "MISS")], d) == {d: -1.0}
    assert ask(spark, [(d, JUNE, "8-K", "MEET")], d) == {d: 0.0}
    assert ask(spark, [(d, date(2025, 3, 31), "8-K", "BEAT")], d) == {d: 0.0}
    assert ask(spark, [(d, JUNE, "10-Q", "BEAT")], d) == {d: 0.0}
    assert ask(spark, [(d, JUNE, "10-Q", "BEAT")], d, announcement_only=False) == {d: 1.0}


def test_earliest_announcement_of_a_period_wins(spark):
    got = ask(spark, [(date(2025, 8, 13), JUNE, "8-K", "BEAT"), (date(2025, 8, 1), JUNE, "8-K", "BEAT")],
              date(2025, 8, 2), date(2025, 8, 14))
    assert got == {date(2025, 8, 2): 1.0, date(2025, 8, 14): 0.0}


def test_fallback_has_no_look_ahead(spark):
    q, k = date(2025, 8, 1), date(2025, 8, 12)
    got = ask(spark, [(q, JUNE, "10-Q", "BEAT"), (k, JUNE, "8-K", "MISS"), (date(2025, 8, 13), JUNE, "10-K", "BEAT")],
              date(2025, 8, 4), date(2025, 8, 12), date(2025, 8, 13), announcement_only=False)
    assert got == {date(2025, 8, 4): 1.0, date(2025, 8, 12): -1.0, date(2025, 8, 13): -1.0}


def test_model_registry(spark):
    grid = spark.createDataFrame([("T", JUNE)], "ticker STRING, date DATE")
    answers = spark.createDataFrame([("T", JUNE, 0.5, False)], "ticker STRING, date DATE, value DOUBLE, abstained BOOLEAN")
    model = signals.answered_model("value", "long_only")
    assert [tuple(r) for r in model(grid, {"value": answers}).collect()] == [("value", "T", JUNE, 0.5, False, "")]
    nobody = answers.where("ticker = 'X'")
    silent = model(grid, {"value": nobody}).collect()[0]
    assert silent.abstained is True and silent.reason == "no answer"
    with pytest.raises(ValueError):
        signals.run_models(["nope"], grid, {})
    with pytest.raises(ValueError):
        signals.SignalModel("bad", "sideways", lambda g, t: g)


def test_rsi_edges(spark):
    up = [("U", JUNE + timedelta(days=i), 100.0 + i) for i in range(16)]
    flat = [("F", JUNE + timedelta(days=i), 100.0) for i in range(16)]
    df = spark.createDataFrame(up + flat, "ticker STRING, d DATE, close DOUBLE")
    got = {(r.ticker, r.d): r.rsi for r in relative_strength(df).collect()}
    assert got[("U", JUNE + timedelta(days=12))] == 50.0 and got[("U", JUNE + timedelta(days=13))] == 100.0
    assert got[("F", JUNE + timedelta(days=15))] == 50.0


def test_rebalance_grid(spark):
    days = [date(2024, 12, 30), date(2024, 12, 31), date(2025, 1, 2), date(2025, 1, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d DATE")
    pick = lambda c: sorted(r.d for r in rebalance_days(df, c).collect())
    assert pick("weekly") == [days[3]] and pick("monthly") == [days[1], days[3]] and pick("daily") == days
    with pytest.raises(ValueError):
        rebalance_days(df, "hourly")


def test_onset_and_resample(spark):
    df = spark.createDataFrame([("a", JUNE + timedelta(days=i), v) for i, v in enumerate([1.0, 1.0, 0.0, -1.0])],
                               "ticker STRING, d DATE, value DOUBLE")
    assert [r.onset for r in onset(df, df.value != 0).orderBy("d").collect()] == [True, False, False, True]
    got = [r.value for r in resample_curve(df, ["ticker"], "d", "value", 7).orderBy("i").collect()]
    assert got == pytest.approx([1, 1, 1, 0.5, 0, -0.5, -1])
    one = resample_curve(df.limit(1), ["ticker"], "d", "value", 3)
    assert [r.value for r in one.collect()] == [1.0, 1.0, 1.0]
