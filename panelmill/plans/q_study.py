"""Event-study and return-series queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import eventstudy as es
from ..operators import running as run
from ..operators import series
from ..session import stored
from .registry import query


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round the named columns once, at the output edge."""
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def study(t) -> DataFrame:
    return es.event_study(t.filings, t.closes, t.market)


def returns(t) -> DataFrame:
    return series.aligned_returns(t.closes, t.market)


def paths(t) -> DataFrame:
    return es.event_study(t.filings, t.closes, t.market, daily_path=True)


def daily(t) -> DataFrame:
    return es.daily_rows(paths(t))


@query("event_study", """
    SELECT e.filing_id, e.ticker, e.filing_date, e.report_period, e.source_type, e.eps_surprise, e.event_day, e.idx,
           round(f.alpha, 6) AS alpha, round(f.beta, 6) AS beta, round(f.r_squared, 6) AS r_squared, f.n_obs,
           round(c.car_0_1, 6) AS car_0_1, round(c.car_0_5, 6) AS car_0_5, round(c.car_0_20, 6) AS car_0_20
    FROM snapped e JOIN fits f ON e.filing_id = f.filing_id JOIN cars c ON e.filing_id = c.filing_id
    """, "snapped fits cars")
def event_study(t):
    return rounded(study(t), "alpha", "beta", "r_squared", "car_0_1", "car_0_5", "car_0_20")


# Tickers of the test tables trade on one day in four, so the range is wider than a study of daily bars needs.
LIMITED = {"earnings_limit": 40, "require_eps_surprise": True, "price_range": (1400, 35)}


@query("event_study_limited", """
    WITH newest AS (SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, report_period DESC, filing_id DESC) <= 40),
    kept AS (SELECT * FROM newest WHERE date_diff('day', report_period, filing_date) < 45),
    spans AS (SELECT ticker, min(filing_date) - 1400 AS lo, max(filing_date) + 35 AS hi FROM kept GROUP BY 1),
    near AS (
      SELECT ticker, d, y, x, row_number() OVER (PARTITION BY ticker ORDER BY d) - 1 AS idx FROM (
        SELECT b.ticker, b.d, (b.close - lag(b.close) OVER w) / lag(b.close) OVER w AS y, (m.close - lag(m.close) OVER w) / lag(m.close) OVER w AS x
        FROM bars b JOIN market m ON b.d = m.d JOIN spans s ON s.ticker = b.ticker AND b.d BETWEEN s.lo AND s.hi
        WINDOW w AS (PARTITION BY b.ticker ORDER BY b.d)) WHERE y IS NOT NULL),
    day0 AS (
      SELECT f.*, r.d AS event_day, r.idx FROM kept f JOIN near r ON r.ticker = f.ticker AND r.d BETWEEN f.filing_date AND f.filing_date + 4
      WHERE f.eps_surprise IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f.filing_id ORDER BY r.d) = 1),
    fit AS (
      SELECT e.filing_id, regr_intercept(r.y, r.x) AS alpha, regr_slope(r.y, r.x) AS beta, regr_r2(r.y, r.x) AS r_squared, count(*) AS n_obs
      FROM day0 e JOIN near r ON r.ticker = e.ticker AND r.idx BETWEEN e.idx - 250 AND e.idx - 11 WHERE e.idx >= 250 GROUP BY 1),
    car AS (
      SELECT e.filing_id, CASE WHEN max(r.idx - e.idx) >= 5 THEN sum(r.y - (f.alpha + f.beta * r.x)) FILTER (WHERE r.idx - e.idx <= 5) END AS car_0_5
      FROM day0 e JOIN fit f ON f.filing_id = e.filing_id JOIN near r ON r.ticker = e.ticker AND r.idx BETWEEN e.idx AND e.idx + 20 GROUP BY 1)
    SELECT e.filing_id, e.ticker, e.eps_surprise, e.event_day, e.idx, round(f.alpha, 6) AS alpha, round(f.beta, 6) AS beta,
           round(f.r_squared, 6) AS r_squared, f.n_obs, round(c.car_0_5, 6) AS car_0_5
    FROM day0 e JOIN fit f ON f.filing_id = e.filing_id JOIN car c ON c.filing_id = e.filing_id""", "filings bars market")
def event_study_limited(t):
    """The newest filings of a ticker, labelled ones only, over the prices around them."""
    found = es.event_study(t.filings, t.closes, t.market, **LIMITED)
    kept = found.select("filing_id", "ticker", "eps_surprise", "event_day", "idx", "alpha", "beta", "r_squared", "n_obs", "car_0_5")
    return rounded(kept, "alpha", "beta", "r_squared", "car_0_5")


@query("event_daily_path", """
    SELECT e.filing_id, e.ticker, e.event_day, p.daily_ar, p.n_days, p.last_ar FROM snapped e JOIN (
      SELECT filing_id, string_agg(printf('%.6f', round(ar, 6) + 0.0), ',' ORDER BY off) AS daily_ar, count(*) AS n_days,
             round(arg_max(ar, off), 6) AS last_ar FROM ars GROUP BY 1) p ON p.filing_id = e.filing_id""", "snapped ars")
def event_daily_path(t):
    """Each event with its abnormal returns by day, 21 at most."""
    figures = F.array_join(F.transform("daily_ar", lambda v: F.format_string("%.6f", F.round(v, 6) + F.lit(0.0))), ",")
    out = paths(t).where(F.col("filing_id").isNotNull()).select(
        "filing_id", "ticker", "event_day", figures.alias("daily_ar"), F.size("daily_ar").cast("bigint").alias("n_days"),
        F.element_at("daily_ar", -1).alias("last_ar"),
    )
    return rounded(out, "last_ar")


@query("join_aligned_series", """
    SELECT b.ticker, b.d, b.close, m.close AS market_close
    FROM bars b JOIN market m ON b.d = m.d""", "bars market")
def join_aligned_series(t):
    return series.aligned_closes(t.closes, t.market).select("ticker", "d", "close", "market_close")


@query("intersect_days", """
    SELECT ticker, d FROM bars WHERE d IN (SELECT d FROM market)""", "bars market")
def intersect_days(t):
    return series.shared_days(t.closes, t.market)


@query("daily_returns", "SELECT ticker, d, round(y, 6) AS y, round(x, 6) AS x FROM returns", "returns")
def daily_returns(t):
    return rounded(returns(t).select("ticker", "d", "y", "x"), "y", "x")


@query("trading_day_index", "SELECT ticker, d, idx FROM returns", "returns")
def trading_day_index(t):
    return returns(t).select("ticker", "d", "idx")


@query("join_event_snap", "SELECT filing_id, ticker, filing_date, event_day, idx FROM snapped", "snapped")
def join_event_snap(t):
    days = returns(t).select("ticker", F.col("d").alias("event_day"), "idx")
    timely = es.drop_retrospective(t.filings).select("filing_id", "ticker", "filing_date")
    snapped = es.snap_forward(timely, days, ["ticker"], "event_day", "filing_date", tolerance=es.SNAP_DAYS)
    return snapped.select("filing_id", "ticker", "filing_date", "event_day", "idx")


@query("join_estimation_window", """
    SELECT e.filing_id, e.ticker, e.idx, count(*) AS n, round(sum(r.x), 6) AS sum_x, round(sum(r.y), 6) AS sum_y,
           round(sum(r.x * r.x), 6) AS sum_xx, round(sum(r.x * r.y), 6) AS sum_xy, round(sum(r.y * r.y), 6) AS sum_yy
    FROM snapped e JOIN returns r ON r.ticker = e.ticker AND r.idx BETWEEN e.idx - 250 AND e.idx - 11
    WHERE e.idx >= 250 GROUP BY e.filing_id, e.ticker, e.idx""", "snapped returns")
def join_estimation_window(t):
    m = {f: F.col(f"est_{f}") for f in ("n", "mx", "my", "mxx", "mxy", "myy")}
    sums = es.estimation_moments(es.return_panel(t.closes, t.market)).select(
        "ticker", F.col("idx").alias("_i"), m["n"].alias("n"),
        (m["n"] * m["mx"]).alias("sum_x"), (m["n"] * m["my"]).alias("sum_y"),
        *[(m[f"m{p}{q}"] + m["n"] * m[f"m{p}"] * m[f"m{q}"]).alias(f"sum_{p}{q}") for p, q in ("xx", "xy", "yy")],
    )
    events = join_event_snap(t).select("filing_id", "ticker", "idx", F.col("idx").alias("_i"))
    joined = events.join(sums, ["ticker", "_i"]).drop("_i")
    return rounded(joined, "sum_x", "sum_y", "sum_xx", "sum_xy", "sum_yy")


@query("join_event_window", """
    SELECT e.filing_id, r.idx - e.idx AS off, round(r.y, 6) AS y, round(r.x, 6) AS x
    FROM snapped e JOIN returns r ON r.ticker = e.ticker AND r.idx BETWEEN e.idx AND e.idx + 20
    WHERE e.idx >= 250""", "snapped returns")
def join_event_window(t):
    events = join_event_snap(t).where("idx >= 250")
    wanted = events.select(
        "filing_id", "ticker", F.col("idx").alias("_0"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(es.LAST_OFFSET).cast("bigint"))).alias("off"),
    ).withColumn("idx", F.col("_0") + F.col("off"))
    joined = wanted.join(returns(t).select("ticker", "idx", "y", "x"), ["ticker", "idx"])
    return rounded(joined.select("filing_id", "off", "y", "x"), "y", "x")


@query("market_model_fit", """
    SELECT filing_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(r_squared, 6) AS r_squared, n_obs
    FROM fits""", "fits")
def market_model_fit(t):
    fits = study(t).select("filing_id", "alpha", "beta", "r_squared", "n_obs")
    return rounded(fits, "alpha", "beta", "r_squared")


@query("abnormal_returns", "SELECT filing_id, off, round(ar, 6) AS ar FROM ars", "ars")
def abnormal_returns(t):
    return rounded(daily(t).select("filing_id", F.col("off").cast("bigint").alias("off"), "ar"), "ar")


@query("car_windows", """
    SELECT filing_id, round(car_0_1, 6) AS car_0_1, round(car_0_5, 6) AS car_0_5, round(car_0_20, 6) AS car_0_20
    FROM cars""", "cars")
def car_windows(t):
    return rounded(es.car_windows(daily(t)), "car_0_1", "car_0_5", "car_0_20")


@query("car_stats", """
    SELECT t.source_type, t.n_total, g."window", g.n_events, round(g.mean_car, 6) AS mean_car, round(g.std_car, 6) AS std_car
    FROM (SELECT source_type, count(*) AS n_total FROM cars GROUP BY 1) t
    LEFT JOIN car_groups g ON g.source_type = t.source_type""", "car_groups")
def car_stats(t):
    return rounded(es.car_stats(study(t)), "mean_car", "std_car")


# Student t by the continued fraction of the incomplete beta function, one step per recursion.
T_SQL = """
    WITH RECURSIVE stats AS (
      SELECT source_type, "window", n_events, mean_car / (std_car / sqrt(n_events)) AS t, n_events - 1 AS df FROM car_groups),
    side AS (
      SELECT *, df / (df + t * t) AS x0, (df / 2.0 + 1) / (df / 2.0 + 2.5) AS cut FROM stats),
    setup AS (
      SELECT *, x0 < cut AS direct, CASE WHEN x0 < cut THEN df / 2.0 ELSE 0.5 END AS a,
             CASE WHEN x0 < cut THEN 0.5 ELSE df / 2.0 END AS b, CASE WHEN x0 < cut THEN x0 ELSE 1 - x0 END AS x FROM side),
    step AS (
      SELECT source_type, "window", 0 AS m, CAST(1.0 AS DOUBLE) AS c, 1.0 / (1.0 - (a + b) * x / (a + 1)) AS d,
             1.0 / (1.0 - (a + b) * x / (a + 1)) AS h FROM setup
      UNION ALL
      SELECT source_type, "window", m, c2, d2, h1 * c2 * d2 FROM (
        SELECT *, 1.0 + o / c1 AS c2, 1.0 / (1.0 + o * d1) AS d2 FROM (
          SELECT *, h * c1 * d1 AS h1 FROM (
            SELECT s.source_type, s."window", s.m + 1 AS m, s.h,
                   1.0 + e.ev / s.c AS c1, 1.0 / (1.0 + e.ev * s.d) AS d1, e.o
            FROM step s JOIN (
              SELECT source_type, "window", i,
                     i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)) AS ev,
                     -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1)) AS o
              FROM setup, range(1, 301) g(i)) e
            ON e.source_type = s.source_type AND e."window" = s."window" AND e.i = s.m + 1)))),
    last AS (SELECT source_type, "window", h FROM step WHERE m = 300)
    SELECT s.source_type, s."window", s.n_events, round(s.t, 6) AS t_stat,
           round(CASE WHEN direct THEN tail ELSE 1 - tail END, 6) AS p_value
    FROM (SELECT u.*, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) * l.h / a AS tail
          FROM setup u JOIN last l ON l.source_type = u.source_type AND l."window" = u."window") s"""


@query("car_ttest", T_SQL, "car_groups")
def car_ttest(t):
    tested = es.car_ttest(es.car_stats(study(t)).where("window IS NOT NULL"))
    return rounded(tested.select("source_type", "window", "n_events", "t_stat", "p_value"), "t_stat", "p_value")


DRAWS = 10_000
INTERVAL_SQL = """
    SELECT source_type, "window", round(quantile_cont(mean, 0.025), 6) AS lower, round(quantile_cont(mean, 0.975), 6) AS upper,
           CAST(0.95 AS DOUBLE) AS confidence, CAST(10000 AS BIGINT) AS n_bootstrap
    FROM means GROUP BY 1, 2"""


def _drawn_sql(item: str, columns: str, source: str) -> str:
    """The draws of eventstudy._draws as nested selects."""
    first = es.DRAW_SQL.format(item=item, draw="r.b", seed=42)
    sql = f"SELECT {columns}, r.b, {first} AS u FROM {source}, range(10000) r(b)"
    for c in (12345, 67890, 13579):
        sql = f"SELECT * REPLACE ({es.SQUARE_SQL.format(x='u', c=c)} AS u) FROM ({sql})"
    return sql


BOOTSTRAP_MEANS = """
    slots AS (
      SELECT *, row_number() OVER (PARTITION BY source_type, "window" ORDER BY filing_id) - 1 AS slot,
             count(*) OVER (PARTITION BY source_type, "window") AS n FROM car_rows),
    draws AS (SELECT source_type, "window", b, u % n AS slot FROM ({draws})),
    means AS (
      SELECT d.source_type, d."window", d.b, avg(s.car) AS mean FROM draws d JOIN slots s
      ON s.source_type = d.source_type AND s."window" = d."window" AND s.slot = d.slot GROUP BY 1, 2, 3)""".format(draws=_drawn_sql("slot", 'source_type, "window", n', "(SELECT * FROM slots WHERE n >= 2)"))


@query("bootstrap_ci", f"WITH {BOOTSTRAP_MEANS} {INTERVAL_SQL}", "car_rows")
def bootstrap_ci(t):
    slots = stored(es.bootstrap_slots(stored(study(t), "events")), "slots")
    return rounded(es.bootstrap_ci(slots, n_bootstrap=DRAWS, seed=42), "lower", "upper")


_POISSON_CASE = " ".join(f"WHEN u < {cut} THEN {k}" for k, cut in enumerate(es.POISSON_CUTS))


@query("bootstrap_ci_poisson", f"""
    WITH weighted AS (
      SELECT filing_id, b, CASE {_POISSON_CASE} ELSE {len(es.POISSON_CUTS)} END AS w FROM (
        SELECT filing_id, b, u * 2 AS u FROM ({_drawn_sql("filing_id", "filing_id", "cars")}))),
    means AS (
      SELECT c.source_type, c."window", p.b, sum(p.w * c.car) / sum(p.w) AS mean
      FROM car_rows c JOIN weighted p ON p.filing_id = c.filing_id GROUP BY 1, 2, 3)
    {INTERVAL_SQL}""", "cars car_rows")
def bootstrap_ci_poisson(t):
    return rounded(es.bootstrap_ci_poisson(study(t), n_bootstrap=DRAWS, seed=42), "lower", "upper")


@query("car_histogram", """
    WITH v AS (SELECT source_type, car_0_1 * 100 AS v FROM cars WHERE car_0_1 IS NOT NULL),
    g AS (SELECT source_type, min(v) AS lo, max(v) AS hi, avg(v) AS mean_pct FROM v GROUP BY 1),
    k AS (SELECT v.source_type, least(CAST(floor((v - lo) / (hi - lo) * 20) AS BIGINT), 19) AS bin, count(*) AS n
          FROM v JOIN g ON g.source_type = v.source_type GROUP BY 1, 2)
    SELECT g.source_type, b.bin, round(lo + b.bin * (hi - lo) / 20, 6) AS left_edge,
           coalesce(k.n, 0) AS n, round(mean_pct, 6) AS mean_pct
    FROM g CROSS JOIN (SELECT range AS bin FROM range(20)) b
    LEFT JOIN k ON k.source_type = g.source_type AND k.bin = b.bin""", "cars")
def car_histogram(t):
    values = stored(study(t).select("source_type", "car_0_1"), "values")  # read for the span and for the counts
    return rounded(es.car_histogram(values, "[0,+1]"), "left_edge", "mean_pct")


@query("car_path", """
    WITH ends AS (SELECT source_type, max(off) AS last FROM ars GROUP BY 1),
    grid AS (SELECT e.source_type, e.filing_id, o.off FROM (SELECT DISTINCT source_type, filing_id FROM ars) e
             JOIN ends ON ends.source_type = e.source_type JOIN (SELECT range AS off FROM range(21)) o ON o.off <= ends.last),
    path AS (SELECT g.source_type, g.off, sum(coalesce(a.ar, 0)) OVER (PARTITION BY g.filing_id ORDER BY g.off) AS cum
             FROM grid g LEFT JOIN ars a ON a.filing_id = g.filing_id AND a.off = g.off)
    SELECT source_type, off, count(*) AS n, round(avg(cum) * 100, 6) AS mean_pct,
           round(stddev_samp(cum) / sqrt(count(*)) * 100, 6) AS se_pct FROM path GROUP BY 1, 2""", "ars")
def car_path(t):
    path = es.car_path_of(paths(t)).withColumn("off", F.col("off").cast("bigint"))
    return rounded(path, "mean_pct", "se_pct")


@query("car_bars", f"""
    WITH {BOOTSTRAP_MEANS}, ci AS ({INTERVAL_SQL.replace('round(', '(').replace(', 6)', ')')}),
    grid AS (SELECT s.source_type, w."window" FROM (SELECT DISTINCT source_type FROM cars) s,
             (VALUES ('[0,+1]'), ('[0,+5]'), ('[0,+20]')) w("window"))
    SELECT g.source_type, g."window", round(coalesce(c.mean_car * 100, 0), 6) AS mean_pct,
           round(coalesce((c.mean_car - ci.lower) * 100, 0), 6) AS below_pct,
           round(coalesce((ci.upper - c.mean_car) * 100, 0), 6) AS above_pct
    FROM grid g LEFT JOIN car_groups c ON c.source_type = g.source_type AND c."window" = g."window"
    LEFT JOIN ci ON ci.source_type = g.source_type AND ci."window" = g."window" """, "cars car_groups")
def car_bars(t):
    events = stored(study(t), "events")
    slots = stored(es.bootstrap_slots(events), "slots")
    bars = es.car_bars(es.car_stats(events), es.bootstrap_ci(slots, n_bootstrap=DRAWS, seed=42))
    return rounded(bars, "mean_pct", "below_pct", "above_pct")


@query("skipped_tickers", """
    SELECT DISTINCT ticker FROM filings WHERE ticker NOT IN (SELECT ticker FROM snapped WHERE idx >= 250)
    """, "filings snapped")
def skipped_tickers(t):
    return es.skipped_tickers(t.filings, study(t))


@query("min_history_gate_events", """
    WITH depth AS (SELECT ticker, count(*) + 1 AS aligned_days FROM returns GROUP BY 1),
    day0 AS (SELECT filing_id, idx FROM snapped_all)
    SELECT f.filing_id, CASE WHEN coalesce(p.aligned_days, 0) < 220 THEN 'too few aligned days'
        WHEN s.idx IS NULL THEN 'no trading day after the filing'
        WHEN s.idx - 250 < 0 THEN 'short estimation window' ELSE 'ok' END AS reason
    FROM filings f LEFT JOIN depth p ON p.ticker = f.ticker LEFT JOIN day0 s ON s.filing_id = f.filing_id""",
    "filings returns snapped_all")
def min_history_gate_events(t):
    return es.gate_history(t.filings, t.closes, t.market).select("filing_id", "reason")


@query("exit_at_offset", """
    SELECT ticker, d, close, lead(d, 5) OVER w AS exit_date, lead(close, 5) OVER w AS exit_price
    FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)""", "bars")
def exit_at_offset(t):
    return series.exit_at(t.closes, 5)


@query("rebalance_grid", """
    SELECT 'weekly' AS cadence, max(d) AS d FROM market GROUP BY isoyear(d), weekofyear(d)
    UNION ALL SELECT 'monthly', max(d) FROM market GROUP BY year(d), month(d)
    UNION ALL SELECT 'daily', d FROM market""", "market")
def rebalance_grid(t):
    days = t.market.select("d")
    out = None
    for cadence in ("weekly", "monthly", "daily"):
        part = series.rebalance_days(days, cadence).select(F.lit(cadence).alias("cadence"), "d")
        out = part if out is None else out.unionByName(part)
    return out


@query("drawdown", """
    SELECT ticker, d, peak, round((peak - close) / peak, 6) AS drawdown FROM (
      SELECT ticker, d, close, max(close) OVER (PARTITION BY ticker ORDER BY d) AS peak FROM bars)""", "bars")
def drawdown(t):
    fallen = series.drawdown(t.closes, ["ticker"], "d", "close")
    return rounded(fallen.select("ticker", "d", "peak", "drawdown"), "drawdown")


@query("benchmark_nav", """
    SELECT d, round(100000.0::DOUBLE * close / (SELECT arg_min(close, d) FROM market), 6) AS benchmark_nav FROM market
    """, "market")
def benchmark_nav(t):
    nav = series.scaled_benchmark(t.market.select("d", "close"), F.lit(100000.0))
    return rounded(nav.select("d", "benchmark_nav"), "benchmark_nav")


@query("rsi", """
    WITH moves AS (
      SELECT ticker, d, coalesce(greatest(close - p, 0), 0) AS gain, coalesce(greatest(p - close, 0), 0) AS loss
      FROM (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY d) AS p FROM bars)),
    means AS (
      SELECT ticker, d, avg(gain) OVER w AS gain, avg(loss) OVER w AS loss, count(*) OVER w AS n FROM moves
      WINDOW w AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
    SELECT ticker, d, round(CASE WHEN n < 14 OR (gain = 0 AND loss = 0) THEN 50.0 WHEN loss = 0 THEN 100.0
                      ELSE 100.0 - 100.0 / (1.0 + gain / loss) END::DOUBLE, 6) AS rsi FROM means""", "bars")
def rsi(t):
    return rounded(series.relative_strength(t.closes), "rsi")


@query("percentile_rank", """
    SELECT ticker, d, ((below * 200000000 + n) // (2 * n)) / 1000000.0::DOUBLE AS pct_rank FROM (
      SELECT ticker, d, rank() OVER (PARTITION BY date_trunc('month', d) ORDER BY close) - 1 AS below,
             count(*) OVER (PARTITION BY date_trunc('month', d)) AS n FROM bars)""", "bars")
def percentile_rank(t):
    closes = t.closes.select("ticker", "d", F.trunc("d", "MM").alias("month"), "close")
    return run.share_below(closes, ["month"], "close", digits=6).select("ticker", "d", "pct_rank")


@query("resample_curve", """
    WITH p AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY d) - 1 AS j, close FROM bars),
    n AS (SELECT ticker, count(*) AS n FROM p GROUP BY 1),
    g AS (SELECT ticker, n, i, i * ((n - 1) / 59.0::DOUBLE) AS pos FROM n, range(60) r(i))
    SELECT g.ticker, g.i, round(lo.close * (1 - (pos - floor(pos))) + hi.close * (pos - floor(pos)), 9) AS value
    FROM g JOIN p lo ON lo.ticker = g.ticker AND lo.j = CAST(floor(pos) AS BIGINT)
    JOIN p hi ON hi.ticker = g.ticker AND hi.j = least(CAST(floor(pos) AS BIGINT) + 1, n - 1)""", "bars")
def resample_curve(t):
    return rounded(series.resample_curve(t.closes, ["ticker"], "d", "close", 60), "value", digits=9)
