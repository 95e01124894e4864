import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelmill.operators import trades as tr

D0 = date(2025, 8, 4)


def panel(spark, values, ticker="T", price=None):
    rows = [(ticker, D0 + timedelta(days=i), float(v), float(price[i] if price else 50.0 + i)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker STRING, d DATE, value DOUBLE, close DOUBLE")


def walk(values, hold, grid_end=None):
    """The day-by-day rule, by hand."""
    out, armed, i, n = [], True, 0, len(values)
    stop = n if grid_end is None else grid_end
    while i < stop:
        if armed and values[i] != 0:
            if i + hold >= n:
                break
            out.append(i)
            armed, i = False, i + hold
            continue
        if values[i] == 0:
            armed = True
        i += 1
    return out


def entries(df, **kw):
    return sorted((r.entry_date - D0).days for r in tr.non_overlapping_entries(df, **kw).collect())


def test_always_on_gives_one_trade_and_onsets_do_not_overlap(spark):
    assert entries(panel(spark, [1] * 20)) == [0]
    assert entries(panel(spark, [0, 1, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0])) == [1, 8]


@pytest.mark.parametrize("hold", [1, 2, 5])
def test_entries_match_the_walk(spark, hold):
    rng = random.Random(hold)
    frames, want = None, {}
    for k in range(12):
        values = [rng.choice([0, 0, 1, -1]) for _ in range(40)]
        df = panel(spark, values, ticker=f"T{k}")
        frames = df if frames is None else frames.unionByName(df)
        want[f"T{k}"] = (walk(values, hold), walk(values, hold, grid_end=30))
    end = (D0 + timedelta(days=29)).isoformat()
    for which, kw in ((0, {}), (1, {"end": end})):
        got = {}
        for r in tr.non_overlapping_entries(frames, hold=hold, **kw).collect():
            got.setdefault(r.ticker, []).append((r.entry_date - D0).days)
        assert {k: sorted(v) for k, v in got.items()} == {k: v[which] for k, v in want.items() if v[which]}


def test_sizes_and_direction(spark):
    df = panel(spark, [1] + [0] * 9, price=[50.0] + [55.0] * 9)
    bars = df.select("ticker", "d", "close")
    t = tr.fixed_hold_trades(tr.non_overlapping_entries(df), bars).collect()[0]
    assert (t.shares, t.pnl, t.return_pct, t.direction) == (200.0, 1000.0, 0.1, "long")
    short = panel(spark, [-1] + [0] * 9, price=[50.0] + [55.0] * 9)
    t = tr.fixed_hold_trades(tr.non_overlapping_entries(short), bars).collect()[0]
    assert (t.pnl, t.direction) == (-1000.0, "short")


def test_curve_and_metrics(spark):
    day = lambda n: date(2024, 1, 1) + timedelta(days=n)
    rows = [("s", "A", "long", day(0), day(5), 1000.0, 0.1, 5), ("s", "B", "short", day(10), day(15), -2000.0, -0.2, 5),
            ("s", "C", "long", day(20), day(25), 500.0, 0.05, 5)]
    df = spark.createDataFrame(rows, "study STRING, ticker STRING, direction STRING, entry_date DATE, exit_date DATE, pnl DOUBLE, return_pct DOUBLE, holding_days INT")
    curve = tr.equity_curve(df, ["study"])
    assert [r.equity for r in curve.orderBy("entry_date").collect()] == [101000.0, 99000.0, 99500.0]
    assert tr.with_start(curve, ["study"]).where("equity = 100000").count() == 1
    m = tr.trade_metrics(df, ["study"]).collect()[0]
    years = 25 / 365.25
    assert m.total_return_pct == -0.005 and m.max_drawdown_pct == pytest.approx(2 / 101, abs=1e-6)
    assert m.annualized_return_pct == pytest.approx(0.995 ** (1 / years) - 1, abs=1e-6)
    mean, std = -0.05 / 3, pytest.approx
    import statistics
    assert m.sharpe_ratio == std(mean / statistics.stdev([0.1, -0.2, 0.05]) * (3 / years) ** 0.5, abs=1e-4)
    assert (m.n_trades, m.n_long, m.n_short, m.win_rate, m.avg_holding_days) == (3, 2, 1, 0.6667, 5.0)
    run = tr.expanding_trade_metrics(df, ["study"]).orderBy("n_trades").collect()
    assert [r.n_trades for r in run] == [1, 2, 3] and run[-1].sharpe_ratio == m.sharpe_ratio
    assert run[0].win_rate == 1.0 and run[-1].max_drawdown_pct == m.max_drawdown_pct
    numbered = tr.number_trades(df, ["study"]).orderBy("seq").select("seq", "ticker").collect()
    assert [tuple(r) for r in numbered] == [(1, "A"), (2, "B"), (3, "C")]


def test_sweep(spark):
    df = panel(spark, [1, 0, 0, 0, 0, 0, 0, 0, 0, 0])
    out = tr.trade_study(df, df.select("ticker", "d", "close"), holds=(2, 4), thresholds=(0.0, 2.0))
    assert sorted((r.holding_days, r.threshold) for r in out.collect()) == [(2, 0.0), (4, 0.0)]
    assert out.where(F.col("threshold") == 2.0).count() == 0
