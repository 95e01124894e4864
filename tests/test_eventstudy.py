import math
from datetime import date, timedelta

import numpy as np
import pytest

from panelmill.functions.student_t import two_sided
from panelmill.operators import eventstudy as es

FILING = "filing_id BIGINT, ticker STRING, filing_date DATE, report_period DATE, source_type STRING, eps_surprise STRING"


def test_fit_recovers_line_and_handles_flat_market(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(0, 0.01, 240)
    y = 0.001 + 1.2 * x + rng.normal(0, 1e-4, 240)
    data = [("line", float(a), float(b)) for a, b in zip(y, x)]
    data += [("still", 0.01 * (i % 5), 0.0) for i in range(50)]
    data += [("quiet", 0.02, 0.01 * (i % 5)) for i in range(50)]
    df = spark.createDataFrame(data, "event STRING, y DOUBLE, x DOUBLE")
    got = {r.event: r for r in es.fit_groups(df, ["event"]).collect()}
    assert got["line"].alpha == pytest.approx(0.001, abs=1e-4) and got["line"].beta == pytest.approx(1.2, abs=0.01)
    assert got["line"].r_squared > 0.99 and got["line"].n_obs == 240
    assert (got["still"].beta, got["still"].r_squared) == (0.0, 0.0) and got["still"].alpha == pytest.approx(0.02)
    assert got["quiet"].r_squared == 0.0


def test_window_sums(spark):
    ar = [0.01, 0.005, -0.002, 0.003, 0.001, 0.002]
    df = spark.createDataFrame([(1, i, a) for i, a in enumerate(ar)], "filing_id INT, off INT, ar DOUBLE")
    row = es.car_windows(df).collect()[0]
    assert row.car_0_1 == pytest.approx(0.015) and row.car_0_5 == pytest.approx(0.019) and row.car_0_20 is None


def test_retrospective_rule(spark):
    filed = date(2026, 4, 13)
    df = spark.createDataFrame(
        [(1, "GS", filed, date(2026, 3, 31), "8-K", "BEAT"), (2, "GS", filed, date(2025, 12, 31), "8-K", "BEAT"),
         (3, "GS", filed, filed - timedelta(days=44), "8-K", "BEAT"), (4, "GS", filed, filed - timedelta(days=45), "8-K", "BEAT")], FILING)
    assert sorted(r.filing_id for r in es.drop_retrospective(df).collect()) == [1, 3]


def test_t_distribution_known_points():
    assert two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert two_sided(1.0, 2) == pytest.approx(1 - 1 / math.sqrt(3), abs=1e-12)
    assert two_sided(2.228138851964939, 10) == pytest.approx(0.05, abs=1e-9)
    assert two_sided(-12.706204736432095, 1) == pytest.approx(0.05, abs=1e-9)
    assert two_sided(0.0, 7) == pytest.approx(1.0)
    # Wide df against the normal tail.
    assert two_sided(1.96, 10_000_000) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-6)


def series(n=330, seed=5):
    rng = np.random.default_rng(seed)
    days, d = [], date(2023, 1, 2)
    while len(days) < n:
        if d.weekday() < 5:
            days.append(d)
        d += timedelta(days=1)
    market = 100 * np.cumprod(1 + rng.normal(0, 0.01, n))
    stock = 50 * np.cumprod(1 + rng.normal(0, 0.02, n))
    return days, stock, market


def test_event_study_against_least_squares(spark):
    days, stock, market = series()
    bars = spark.createDataFrame([("T", d, float(p)) for d, p in zip(days, stock)], "ticker STRING, d DATE, close DOUBLE")
    mkt = spark.createDataFrame([("M", d, float(p)) for d, p in zip(days, market)], "ticker STRING, d DATE, close DOUBLE")
    saturday = next(d for d in days[270:] if d.weekday() == 4) + timedelta(days=1)
    filed = [days[200], days[251], days[260], saturday, days[-3], days[-1] + timedelta(days=1)]
    filings = spark.createDataFrame([(i, "T", f, f - timedelta(days=20), "8-K", "BEAT") for i, f in enumerate(filed)], FILING)
    got = {r.filing_id: r for r in es.event_study(filings, bars, mkt).collect()}
    assert sorted(got) == [1, 2, 3, 4]  # 0: short estimation window, 5: no day after it
    y, x = np.diff(stock) / stock[:-1], np.diff(market) / market[:-1]
    for i, row in got.items():
        k = next(j for j, d in enumerate(days[1:]) if d >= filed[i])
        assert row.idx == k
        ys, xs = y[k - 250:k - 10], x[k - 250:k - 10]
        coef, *_ = np.linalg.lstsq(np.column_stack([np.ones(240), xs]), ys, rcond=None)
        assert (row.alpha, row.beta) == pytest.approx(tuple(coef), abs=1e-10)
        ar = (y - (coef[0] + coef[1] * x))[k:k + 21]
        for name, end in (("car_0_1", 1), ("car_0_5", 5), ("car_0_20", 20)):
            want = ar[:end + 1].sum() if end < len(ar) else None
            assert row[name] == (pytest.approx(want, abs=1e-10) if want is not None else None)
    events = es.event_study(filings, bars, mkt)
    daily = es.abnormal_returns(events, es.aligned_returns(bars, mkt))
    paths = {r.filing_id: r.daily_ar for r in es.with_daily_path(events, daily).collect()}
    assert len(paths[1]) == 21 and len(paths[4]) == 3
    # A short series is carried flat: all events count at every offset.
    assert {r.n for r in es.car_path(daily).collect()} == {4}


def test_paths_in_the_event_row_equal_the_join_of_days(spark):
    days, stock, market = series(n=285)
    stock[275] = 0.0  # a null return after it
    bars = spark.createDataFrame([("T", d, float(p)) for d, p in zip(days, stock)], "ticker STRING, d DATE, close DOUBLE")
    mkt = spark.createDataFrame([("M", d, float(p)) for d, p in zip(days, market)], "ticker STRING, d DATE, close DOUBLE")
    saturday = next(d for d in days[270:] if d.weekday() == 4) + timedelta(days=1)
    filed = [days[200], days[251], days[251], days[260], days[275], saturday, days[-3], days[-1] + timedelta(days=1)]
    kinds = ["8-K", "10-Q", "8-K", "10-K", "8-K", None, "10-Q", "8-K"]
    filings = spark.createDataFrame([(i, "T", f, f - timedelta(days=20), k, "BEAT") for i, (f, k) in enumerate(zip(filed, kinds))], FILING)
    events = es.event_study(filings, bars, mkt, daily_path=True)
    rows = es.daily_rows(events)
    daily = es.abnormal_returns(es.event_study(filings, bars, mkt), es.aligned_returns(bars, mkt))
    want = {(r.filing_id, r.off): r.ar for r in daily.collect()}
    got = {(r.filing_id, r.off): r.ar for r in rows.collect()}
    assert got == want and len({f for f, _ in got}) == 6 and None in got.values()
    figures = lambda df: {(r.source_type, r.off, c): r[c] for r in df.collect() for c in ("n", "mean_pct", "se_pct")}
    assert figures(es.car_path_of(events)) == pytest.approx(figures(es.car_path(daily)))
    # No row for each event and offset is shuffled or joined: one join of filings, the other one brings the market's days.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "sequence(0, 20" not in plan


def test_bootstrap_brackets_the_mean_and_repeats(spark):
    rng = np.random.default_rng(1)
    cars = rng.normal(0.02, 0.05, 80)
    df = spark.createDataFrame(
        [(i, "8-K", float(c), float(c), float(c)) for i, c in enumerate(cars)],
        "filing_id BIGINT, source_type STRING, car_0_1 DOUBLE, car_0_5 DOUBLE, car_0_20 DOUBLE")
    slots = es.bootstrap_slots(df)
    run = lambda seed: sorted((r.window, round(r.lower, 12), round(r.upper, 12)) for r in es.bootstrap_ci(slots, n_bootstrap=200, seed=seed).collect())
    first = run(42)
    assert first == run(42) != run(43)
    se = cars.std(ddof=1) / math.sqrt(80)
    for got in (first, sorted((r.window, r.lower, r.upper) for r in es.bootstrap_ci_poisson(df, n_bootstrap=200, seed=1).collect())):
        for _, lo, hi in got:
            assert lo < cars.mean() < hi and 2.5 * se < hi - lo < 5.5 * se


def test_histogram_of_equal_values_and_bars_fill(spark):
    df = spark.createDataFrame([(1, "8-K", 0.01, None, None), (2, "8-K", 0.01, None, None)],
                               "filing_id BIGINT, source_type STRING, car_0_1 DOUBLE, car_0_5 DOUBLE, car_0_20 DOUBLE")
    bins = {r.bin: r.n for r in es.car_histogram(df).collect()}
    assert len(bins) == 20 and bins[10] == 2
    stats = es.car_stats(df)
    ci = spark.createDataFrame([("8-K", "[0,+1]", 0.0, 0.02)], "source_type STRING, window STRING, lower DOUBLE, upper DOUBLE")
    got = {r.window: r.mean_pct for r in es.car_bars(stats, ci).collect()}
    assert got == {"[0,+1]": pytest.approx(1.0), "[0,+5]": 0.0, "[0,+20]": 0.0}


def prices(spark, returns, ticker="A"):
    level, rows = 100.0, []
    for i, r in enumerate([0.0, *returns]):
        level *= 1 + r
        rows.append((ticker, date(2015, 1, 1) + timedelta(days=i), float(level)))
    return spark.createDataFrame(rows, "ticker string, d date, close double")


@pytest.mark.parametrize("jump", [0.0, 1e4, 1e8])
@pytest.mark.parametrize("at", [5, 239, 300])
def test_a_jump_outside_the_window_costs_no_digits(spark, jump, at):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 0.01, 900)
    y = 0.5 * x + rng.normal(0, 0.01, 900)
    y[at] = jump or y[at]
    day0 = [600, 650, 719, 720, 721, 800]
    filings = spark.createDataFrame(
        [(i, "A", date(2015, 1, 2) + timedelta(days=i), date(2015, 1, 1) + timedelta(days=i), "8-K", "BEAT") for i in day0], FILING)
    a, m = prices(spark, y), prices(spark, x, "M")
    closes = np.array([r.close for r in a.orderBy("d").collect()])
    market = np.array([r.close for r in m.orderBy("d").collect()])
    ys, xs = np.diff(closes) / closes[:-1], np.diff(market) / market[:-1]
    got = {r.filing_id: r for r in es.event_study(filings, a, m).collect()}
    assert set(got) == set(day0)
    for i, r in got.items():
        wy, wx = ys[i - 250 : i - 10], xs[i - 250 : i - 10]
        beta, alpha = np.polyfit(wx, wy, 1)
        rest = wy - alpha - beta * wx
        assert r.idx == i and r.n_obs == 240
        assert r.alpha == pytest.approx(alpha, abs=1e-12) and r.beta == pytest.approx(beta, rel=1e-9)
        assert r.r_squared == pytest.approx(1 - rest @ rest / ((wy - wy.mean()) @ (wy - wy.mean())), rel=1e-9)
        assert r.car_0_5 == pytest.approx((ys[i : i + 6] - alpha - beta * xs[i : i + 6]).sum(), abs=1e-9)


def test_options_of_the_study(spark):
    rng = np.random.default_rng(4)
    a, m = prices(spark, rng.normal(0, 0.01, 900)), prices(spark, rng.normal(0, 0.01, 900), "M")
    rows = [(i, "A", date(2015, 1, 2) + timedelta(days=i), date(2015, 1, 1) + timedelta(days=i), "8-K", None if i == 850 else "BEAT") for i in (600, 700, 800, 850)]
    filings = spark.createDataFrame(rows, FILING)

    def ids(**options):
        return sorted(r.filing_id for r in es.event_study(filings, a, m, **options).collect())

    assert ids() == [600, 700, 800, 850]
    assert ids(earnings_limit=2) == [800, 850] and ids(require_eps_surprise=True) == [600, 700, 800]
    assert ids(price_range=(240, 35)) == [700, 800, 850]  # the first filing's window is cut off
    full = {r.filing_id: r.beta for r in es.event_study(filings, a, m).collect()}
    near = {r.filing_id: r.beta for r in es.event_study(filings, a, m, price_range=es.PRICE_RANGE).collect()}
    assert near == pytest.approx(full)


def test_both_ways_of_drawing_agree(spark):
    rng = np.random.default_rng(6)
    rows = [("8-K", w, i, float(v)) for w, n in (("[0,+1]", 60), ("[0,+5]", 37), ("[0,+20]", 1)) for i, v in enumerate(rng.normal(size=n))]
    slots = spark.createDataFrame(rows, "source_type string, window string, slot bigint, car double")
    held = {r.window: (r.lower, r.upper) for r in es.bootstrap_ci(slots, n_bootstrap=501).collect()}
    joined = {r.window: (r.lower, r.upper) for r in es.bootstrap_ci(slots, n_bootstrap=501, max_held=0).collect()}
    assert set(held) == {"[0,+1]", "[0,+5]"} == set(joined)
    for w in held:
        assert held[w] == pytest.approx(joined[w])


def test_groups_that_a_task_can_hold_are_never_joined(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 2 * es.BLOCK_SLOTS + 5  # several blocks
    rows = [("8-K", w, i, float(v)) for w, m in (("[0,+1]", n), ("[0,+5]", 40)) for i, v in enumerate(rng.normal(size=m))]
    slots = spark.createDataFrame(rows, "source_type string, window string, slot bigint, car double")
    joined = {r.window: (r.lower, r.upper) for r in es.bootstrap_ci(slots, n_bootstrap=40, max_held=0).collect()}
    monkeypatch.setattr(es, "_joined_means", None)
    held = {r.window: (r.lower, r.upper) for r in es.bootstrap_ci(slots, n_bootstrap=40, max_held=n).collect()}
    assert held == {w: pytest.approx(v) for w, v in joined.items()}


def test_poisson_draws_make_no_rows_and_match_the_formula(spark):
    rng = np.random.default_rng(9)
    cars = rng.normal(size=(70, 3))
    rows = [(10**10 + 31 * i, "8-K" if i % 2 else None, *[None if (i + j) % 11 == 0 else float(c) for j, c in enumerate(cars[i])]) for i in range(70)]
    df = spark.createDataFrame(rows, "filing_id BIGINT, source_type STRING, car_0_1 DOUBLE, car_0_5 DOUBLE, car_0_20 DOUBLE")
    found = es.bootstrap_ci_poisson(df, n_bootstrap=60, seed=5)
    assert "explode(sequence" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.source_type, r.window): (r.lower, r.upper) for r in found.collect()}

    def copies(item, b):
        u = ((item % 1000000007) * 1000003 + b * 7919 + 5) % es.DRAW_PRIME
        for c in (12_345, 67_890, 13_579):
            u = (u * u + c) % es.DRAW_PRIME
        return sum(2 * u >= cut for cut in es.POISSON_CUTS)

    for source in ("8-K", None):
        for j, window in enumerate(es.WINDOWS):
            known = [(r[0], r[2 + j]) for r in rows if r[1] == source and r[2 + j] is not None]
            means = []
            for b in range(60):
                w = [copies(i, b) for i, _ in known]
                means.append(sum(k * c for k, (_, c) in zip(w, known)) / sum(w))
            assert got[source, window] == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


def test_car_stats_read_the_events_once(spark):
    df = spark.createDataFrame([(1, "8-K", 0.01, 0.5, None), (2, "8-K", 0.03, None, None), (3, "10-Q", 0.02, 0.1, 0.1), (4, None, 0.1, 0.1, 0.1), (5, None, 0.2, 0.1, 0.1)],
                               "filing_id BIGINT, source_type STRING, car_0_1 DOUBLE, car_0_5 DOUBLE, car_0_20 DOUBLE")
    stats = es.car_stats(df)
    assert stats._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    got = {(r.source_type, r.n_total, r.window, r.n_events, r.mean_car and round(r.mean_car, 9)) for r in stats.collect()}
    assert got == {("8-K", 2, "[0,+1]", 2, 0.02), ("10-Q", 1, None, None, None), (None, 2, None, None, None)}
