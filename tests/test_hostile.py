"""Rows that once gave wrong, missing or aborted results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelmill.functions.text import title_from_slug
from panelmill.operators import eventstudy, orders, portfolio, risk, running, series, signals, trades
from panelmill.operators.keyed import with_totals

D0 = dt.date(2020, 1, 1)
NAN = float("nan")


def bars_of(spark, closes, ticker="A"):
    return spark.createDataFrame([(ticker, D0 + dt.timedelta(i), float(c)) for i, c in enumerate(closes)], "ticker string, d date, close double")


def test_zero_and_nan_closes_spoil_their_own_windows(spark):
    n = 620
    market = [100 + (i * 7 % 13) for i in range(n)]
    closes = [50 + (i * 5 % 11) + 0.3 * m for i, m in enumerate(market)]
    broken = list(closes)
    broken[25], broken[27] = 0.0, NAN
    filing = [(1, "A", D0 + dt.timedelta(260), 1), (2, "A", D0 + dt.timedelta(560), 2)]
    filings = spark.createDataFrame(
        [(i, t, d, d - dt.timedelta(10), "8-K", "BEAT") for i, t, d, _ in filing],
        "filing_id bigint, ticker string, filing_date date, report_period date, source_type string, eps_surprise string",
    )
    m = bars_of(spark, market, "MKT")
    got = {r.filing_id: r for r in eventstudy.event_study(filings, bars_of(spark, broken), m).collect()}
    want = {r.filing_id: r for r in eventstudy.event_study(filings, bars_of(spark, closes), m).collect()}
    assert set(want) == {1, 2} and set(got) == {2}
    assert got[2].beta == pytest.approx(want[2].beta) and got[2].car_0_20 == pytest.approx(want[2].car_0_20)
    returns = {r.idx: r.y for r in series.aligned_returns(bars_of(spark, broken), m).collect()}
    assert returns[25] is None and returns[40] is not None


def test_two_market_rows_a_day_do_not_fan_out(spark):
    bars = bars_of(spark, [1, 2, 3])
    market = bars_of(spark, [10, 11, 12], "M").unionByName(bars_of(spark, [10, 11, 12], "M"))
    assert series.aligned_closes(bars, market).count() == 3
    assert sorted(tuple(r) for r in series.shared_days(bars, market).collect()) == [("A", D0 + dt.timedelta(i)) for i in range(3)]


def test_nan_never_acts(spark):
    df = spark.createDataFrame([(NAN,), (None,), (0.5,), (-0.5,)], "value double")
    assert sorted(r.direction for r in signals.conviction_filter(df).collect()) == ["long", "short"]
    panel = spark.createDataFrame([("A", D0 + dt.timedelta(i), v) for i, v in enumerate([NAN, 0.0, 1.0] + [0.0] * 8)], "ticker string, d date, value double")
    assert [r.entry_date for r in trades.non_overlapping_entries(panel, hold=2).collect()] == [D0 + dt.timedelta(2)]


def test_sweep_equals_one_setting_at_a_time(spark):
    values = [0, 0.3, 0, 0, -0.8, 0, 0.9, 0.2, 0, 0.6, 0, 0, 0, 0.4, 0, 0, 0, 0]
    panel = spark.createDataFrame([(t, D0 + dt.timedelta(i), float(v) * s) for t, s in (("A", 1), ("B", -1)) for i, v in enumerate(values)], "ticker string, d date, value double")
    bars = panel.select("ticker", "d", (F.lit(100.0) + F.dayofyear("d") % 7).alias("close"))
    swept = trades.trade_study(panel, bars, holds=(2, 4), thresholds=(0.0, 0.5))
    for hold in (2, 4):
        for limit in (0.0, 0.5):
            one = trades.fixed_hold_trades(trades.non_overlapping_entries(panel, hold=hold, threshold=limit), bars, hold=hold)
            mine = swept.where((F.col("holding_days") == hold) & (F.col("threshold") == limit)).drop("threshold")
            assert sorted(map(str, one.collect())) == sorted(map(str, mine.select(*one.columns).collect()))


def fails(df, message):
    with pytest.raises(Exception, match=message):
        df.collect()


MODELS = "strategy string, model_name string, weight double, approach string"
STRATEGIES = "fund string, strategy string, weight double, mode string, gross_target double"


@pytest.mark.parametrize("value,vote,message", [
    (NAN, 1.0, "signal must be finite"), (5.0, 1.0, "signal must be finite"), (None, 1.0, "signal must be finite"),
    (0.5, NAN, "vote weight"), (0.5, 0.0, "vote weight"),
])
def test_bad_votes_stop(spark, value, vote, message):
    got = spark.createDataFrame([("A", D0, "m", value, False)], "ticker string, date date, model_name string, value double, abstained boolean")
    models = spark.createDataFrame([("s", "m", vote, "long_short")], MODELS)
    mandate = spark.createDataFrame([("f", "s", 1.0, "long_short", 1.0)], STRATEGIES)
    fails(portfolio.blend_convictions(portfolio.staff(got, models, mandate)), message)


def test_unknown_model_fund_and_key_stop(spark):
    got = spark.createDataFrame([("A", D0, "other", 0.5, False)], "ticker string, date date, model_name string, value double, abstained boolean")
    models = spark.createDataFrame([("s", "m", 1.0, "long_short")], MODELS)
    mandate = spark.createDataFrame([("f", "s", 1.0, "long_short", 1.0)], STRATEGIES)
    fails(portfolio.staff(got, models, mandate), "no vote weight")
    book = spark.createDataFrame([("g", D0, "A", 0.5)], "fund string, date date, ticker string, netted double")
    limits = spark.createDataFrame([("f", 0.1, 1.0)], "fund string, max_position_pct double, max_gross_exposure double")
    fails(risk.apply_limits(book, limits, portfolio.preserves_proportions(mandate)), "position limit")
    fails(risk.clamp_positions(book.withColumn("fund", F.lit("f")), limits.withColumn("max_gross_exposure", F.lit(NAN))), "gross limit")
    rows = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    fails(with_totals(rows, ["k"], s=F.sum("v")), "k must not be null")


def test_ranks_keep_rows_without_a_value(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0), ("a", 3.0), ("a", 3.0)], "g string, v double")
    got = sorted((str(r.g), str(r.v), r.pct_rank) for r in running.share_below(rows, ["g"], "v").collect())
    assert got == [("None", "2.0", None), ("a", "1.0", 0.0), ("a", "3.0", pytest.approx(100 / 3)), ("a", "3.0", pytest.approx(100 / 3)), ("a", "None", None)]


def test_undated_filing_does_not_win(spark):
    rows = [(1, "A", None, D0, "8-K", "BEAT"), (2, "A", D0, D0, "8-K", "MISS")]
    df = spark.createDataFrame(rows, "filing_id bigint, ticker string, filing_date date, report_period date, source_type string, eps_surprise string")
    assert [r.filing_id for r in signals.best_filing_per_period(df).collect()] == [2]


def test_marks_of_a_day_with_several_bars(spark):
    bars = spark.createDataFrame([("A", D0, 1.0, 1), ("A", D0, 2.0, 2), ("B", D0, NAN, 1)], "ticker string, d date, close double, seq int")
    needed = spark.createDataFrame([("A", D0), ("B", D0), ("C", D0)], "ticker string, session date")
    got = {r.ticker: (r.mark, r.reason) for r in orders.exact_marks(needed, bars, order="seq").collect()}
    assert got["A"] == (2.0, None) and got["B"][1] == "close must be finite and positive" and got["C"] == (None, "missing close")
    plain = orders.exact_marks(needed, bars)
    assert {r.ticker: r.reason for r in plain.collect()}["A"] == "several closes on the day" and plain.count() == 3
    assert [tuple(r) for r in orders.unusable_baskets(orders.exact_marks(needed, bars, order="seq")).select("n_unusable").collect()] == [(2,)]


def test_title_case_after_digits_and_apostrophes(spark):
    df = spark.createDataFrame([("3m-o'neil",), ("plain-NAME",), (None,)], "s string")
    assert [r[0] for r in df.select(title_from_slug(F.lit(""), F.col("s"))).collect()] == ["3M O'Neil", "Plain Name", None]


def test_book_of_a_strategy_outside_the_mandate(spark):
    mandate = spark.createDataFrame([("f", "s", 1.0, "long_short", 1.0)], STRATEGIES)
    funds = spark.createDataFrame([("f", 0.5, 1.0)], "fund string, max_position_pct double, max_gross_exposure double")
    proof = spark.createDataFrame([("f", "s", D0, "A", 0.4, 0.4, None)], "fund string, strategy string, date date, ticker string, score double, weight double, flat_reason string")
    parts = spark.createDataFrame([("f", "s", D0, "A", 0.4), ("f", "ghost", D0, "B", 0.1)], "fund string, strategy string, date date, ticker string, contribution double")
    finals = spark.createDataFrame([("f", D0, "A", 0.4), ("f", D0, "B", 0.1)], "fund string, date date, ticker string, final double")
    found = portfolio.validate_book(proof, proof, parts, finals, mandate, funds).collect()
    assert [(r.rule, r.strategy) for r in found] == [("contribution of a strategy outside the mandate", "ghost")]
