from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from panelmill.operators import funds, ledger
from panelmill.operators.series import scaled_benchmark
from panelmill.sources import reads

FILL = "fund STRING, ticker STRING, session DATE, seq BIGINT, side STRING, quantity BIGINT, price DECIMAL(18,5)"


def weekdays(start, n):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


def fills(spark, rows):
    return spark.createDataFrame([("f", t, d, i, s, q, None) for i, (t, d, s, q, p) in enumerate(rows)], FILL).drop("price").join(
        spark.createDataFrame([(i, float(p)) for i, (*_, p) in enumerate(rows)], "seq BIGINT, p DOUBLE"), "seq"
    ).withColumn("price", F.col("p").cast("decimal(18,5)")).drop("p")


def test_positions_and_cash_after_each_fill(spark):
    d = date(2025, 1, 6)
    df = fills(spark, [("A", d, "buy", 10, 100), ("A", d, "sell", 4, 110), ("A", d, "sell", 9, 120), ("A", d, "buy", 3, 90)])
    shares = [r.shares_after for r in ledger.positions_ledger(df).orderBy("seq").collect()]
    cash = [float(r.cash_after) for r in ledger.cash_ledger(df, F.lit(500.0)).orderBy("seq").collect()]
    assert shares == [10, 6, -3, 0] and cash == [-500.0, -60.0, 1020.0, 750.0]
    assert ledger.closing_positions(df).count() == 0
    tape = ledger.tape_last(df, k=3).orderBy("row").collect()
    assert [(r.book, r.earlier) for r in tape] == [("flat", 1), ("short 3", 1), ("long 6", 1)]


def test_three_week_replay(spark):
    """Weekly rebalance into one name: bought on the Monday after, up on the second Monday, down on the third."""
    days = weekdays(date(2024, 6, 3), 15)
    price = [200.0] * 9 + [210.0] * 5 + [190.0]
    bench = [100.0] * 9 + [102.0] * 5 + [101.0]
    bars = spark.createDataFrame([("AAPL", d, p) for d, p in zip(days, price)], "ticker STRING, d DATE, close DOUBLE")
    sessions = spark.createDataFrame(list(zip(days, bench)), "d DATE, close DOUBLE")
    schedule = funds.schedule_table(sessions, "weekly")
    planned = [(r.d, r.execution_date) for r in schedule.where("rebalances").orderBy("d").collect()]
    assert planned == [(days[4], days[5]), (days[9], days[10]), (days[14], None)]
    assert sorted(r.d for r in funds.assessment_dates(schedule).collect()) == sorted(
        {days[4], days[9], days[14], days[5] - timedelta(days=1), days[10] - timedelta(days=1)})
    df = fills(spark, [("AAPL", days[5], "buy", 500, 200)])
    nav = ledger.daily_nav(df, bars, sessions, F.lit(100_000.0), carry=False)
    got = [(r.session, r.nav, r.n_unpriced) for r in nav.orderBy("session").collect()]
    assert [x[1] for x in got] == [100_000.0] * 9 + [105_000.0] * 5 + [95_000.0] and {x[2] for x in got} == {0}
    joined = nav.join(scaled_benchmark(sessions, F.lit(100_000.0)).select(F.col("d").alias("session"), "benchmark_nav"), "session")
    m = funds.fund_metrics(joined, F.lit(100_000.0)).collect()[0]
    assert (m.total_return_pct, m.benchmark_return_pct, m.excess_return_pct) == (-0.05, 0.01, -0.06)
    assert m.max_drawdown_pct == pytest.approx(10 / 105, abs=1e-6)
    last = funds.expanding_fund_metrics(joined, F.lit(100_000.0)).orderBy(F.col("session").desc()).first()
    assert (last.total_return_pct, last.sharpe_ratio, last.max_drawdown_pct) == (m.total_return_pct, m.sharpe_ratio, m.max_drawdown_pct)
    assessed = spark.createDataFrame([("f", d) for d in (days[9], days[14])], "fund STRING, date DATE")
    assert [r.date for r in funds.pending_proposals(schedule, assessed).collect()] == [days[14]]


def test_carried_and_missing_prices(spark):
    days = weekdays(date(2024, 6, 3), 5)
    bars = spark.createDataFrame([("A", days[0], 10.0), ("A", days[3], 12.0)], "ticker STRING, d DATE, close DOUBLE")
    sessions = spark.createDataFrame([(d,) for d in days], "d DATE")
    df = fills(spark, [("A", days[1], "buy", 2, 10), ("B", days[2], "buy", 1, 5), ("B", days[4], "sell", 1, 6)])
    rows = ledger.daily_nav(df, bars, sessions, F.lit(100.0)).orderBy("session").collect()
    assert [r.nav for r in rows] == [100.0, 100.0, 95.0, 99.0, 105.0]
    assert [r.n_held for r in rows] == [0, 1, 2, 2, 1] and [r.n_unpriced for r in rows] == [0, 0, 1, 1, 0]
    exact = ledger.daily_nav(df, bars, sessions, F.lit(100.0), carry=False).orderBy("session").collect()
    assert [r.n_unpriced for r in exact] == [0, 1, 2, 1, 1]


def test_short_through_zero_accounting(spark):
    d0, d1 = date(2025, 1, 3), date(2025, 1, 6)
    bars = spark.createDataFrame([("A", d0, 200.0), ("A", d1, 200.0)], "ticker STRING, d DATE, close DOUBLE")
    sessions = spark.createDataFrame([(d0,), (d1,)], "d DATE")
    df = fills(spark, [("A", d0, "buy", 50, 200), ("A", d1, "sell", 125, 200)])
    rows = {r.session: r for r in ledger.cycle_accounting(df, bars, sessions, F.lit(15_000.0)).collect()}
    assert (rows[d1].cash_before, rows[d1].equity_before, rows[d1].nav_after) == (5_000.0, 15_000.0, 15_000.0)
    assert rows[d1].cash_after == 30_000.0 and rows[d1].n_positions == 1


def test_rebalanced_nav_chains_periods(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(5)]
    marks = spark.createDataFrame(
        [("A", d, p) for d, p in zip(days, [10.0, 11.0, 12.0, 12.0, 6.0])] + [("B", d, 5.0) for d in days],
        "ticker STRING, as_of DATE, close DOUBLE")
    weights = spark.createDataFrame([("f", days[0], "A", 0.5), ("f", days[0], "B", 0.5), ("f", days[2], "A", 1.0)],
                                    "fund STRING, start DATE, ticker STRING, weight DOUBLE")
    periods = spark.createDataFrame([(days[0], days[2]), (days[2], days[4])], "start DATE, end DATE")
    got = [r.nav for r in ledger.rebalanced_nav(weights, marks, periods).orderBy("session").collect()]
    assert got == pytest.approx([1.05, 1.1, 1.1, 0.55])


def test_sessions_and_completed_days(spark):
    bars = spark.createDataFrame([("M", date(2025, 1, 2), 5.0), ("M", date(2025, 1, 3), 6.0), ("X", date(2025, 1, 3), 9.0)],
                                 "ticker STRING, d DATE, close DOUBLE")
    got = reads.session_closes(bars, "M", "2025-01-01", "2025-01-31")
    assert sorted((r.d.day, r.close) for r in got.collect()) == [(2, 5.0), (3, 6.0)]
    bad = bars.withColumn("close", F.when(F.col("ticker") == "M", -F.col("close")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="finite and positive"):
        reads.session_closes(bad, "M", "2025-01-01", "2025-01-31").collect()
    for stamp, n in (("2025-01-04 04:59:00", 1), ("2025-01-04 05:01:00", 3)):
        assert reads.completed_days(bars, F.to_timestamp(F.lit(stamp))).count() == n


def test_cycle_accounting_reads_prices_once(spark):
    days = [date(2024, 1, 2) + timedelta(days=i) for i in range(6)]
    data = [("F", "A", 0, 1, "buy", 10, "2.5"), ("F", "A", 2, 2, "sell", 4, "3"), ("F", "B", 2, 3, "buy", 1, "7"), ("F", "A", 2, 4, "buy", 1, "3"), ("F", "A", 4, 5, "sell", 7, "1"), (None, "A", 4, 6, "buy", 1, "1")]
    schema = "fund string, ticker string, session date, seq bigint, side string, quantity bigint, price decimal(18,5)"
    fills = spark.createDataFrame([(f, t, days[k], q, s, n, Decimal(p)) for f, t, k, q, s, n, p in data], schema)
    prices = spark.createDataFrame([("A", days[0], 2.0), ("A", days[1], 4.0), ("A", days[4], 5.0)], "ticker string, d date, close double")
    sessions = spark.createDataFrame([(d,) for d in days], "d date")
    out = ledger.cycle_accounting(fills, prices, sessions, F.lit(100))
    got = {(r.session - days[0]).days: (r.cash_before, r.cash_after, r.equity_before, r.nav_after, r.n_fills, r.n_positions) for r in out.collect()}
    # B has no price: its cash moves, its value does not count.
    assert got == {0: (100.0, 75.0, 100.0, 95.0, 1, 1), 2: (75.0, 77.0, 115.0, 105.0, 3, 2), 4: (77.0, 84.0, 112.0, 84.0, 1, 1)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lead(d#") == 1
