"""Ledger, valuation and fund performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, funds, ledger
from .q_study import rounded
from .registry import query

CAPITAL = 100_000_000.0


@query("positions_ledger", """
    SELECT fund, ticker, session, seq, CAST(sum(CASE side WHEN 'buy' THEN quantity ELSE -quantity END)
      OVER (PARTITION BY fund, ticker ORDER BY session, seq) AS BIGINT) AS shares_after FROM fills""", "fills")
def positions_ledger(t):
    return ledger.positions_ledger(t.fills).select("fund", "ticker", "session", "seq", "shares_after")


@query("cash_ledger", """
    SELECT fund, session, seq, CAST(100000000 + sum(CASE side WHEN 'buy' THEN -quantity ELSE quantity END * price)
      OVER (PARTITION BY fund ORDER BY session, seq) AS DOUBLE) AS cash_after FROM fills""", "fills")
def cash_ledger(t):
    out = ledger.cash_ledger(t.fills, F.lit(CAPITAL))
    return out.select("fund", "session", "seq", F.col("cash_after").cast("double").alias("cash_after"))


@query("closing_positions", """
    SELECT fund, ticker, CAST(sum(CASE side WHEN 'buy' THEN quantity ELSE -quantity END) AS BIGINT) AS shares FROM fills
    GROUP BY 1, 2 HAVING sum(CASE side WHEN 'buy' THEN quantity ELSE -quantity END) <> 0""", "fills")
def closing_positions(t):
    return ledger.closing_positions(t.fills)


@query("tape_last_k", """
    WITH p AS (SELECT *, sum(CASE side WHEN 'buy' THEN quantity ELSE -quantity END) OVER (PARTITION BY fund, ticker ORDER BY session, seq) AS s,
      row_number() OVER (PARTITION BY fund ORDER BY session DESC, seq DESC) AS row, count(*) OVER (PARTITION BY fund) AS n FROM fills)
    SELECT fund, row, session, ticker, side, quantity, CAST(price AS DOUBLE) AS price, CAST(quantity * price AS DOUBLE) AS notional,
           CASE WHEN s > 0 THEN 'long ' || s WHEN s < 0 THEN 'short ' || -s ELSE 'flat' END AS book, greatest(n - 12, 0) AS earlier
    FROM p WHERE row <= 12""", "fills")
def tape_last_k(t):
    return ledger.tape_last(t.fills)


def nav(t):
    return ledger.daily_nav(t.fills, t.closes, t.market.select("d"), F.lit(CAPITAL))


@query("daily_nav", "SELECT fund, session, cash, nav, n_held, n_unpriced FROM nav", "nav")
def daily_nav(t):
    return nav(t)


PRICE_DAYS = 7


@query("daily_nav_tolerant", f"""
    WITH cash AS (SELECT fund, session, cash, exact_cash FROM nav),
    spans AS (SELECT h.fund, h.ticker, CAST(h.shares AS BIGINT) AS shares, m.d FROM held h JOIN market m
                ON m.d >= h.session AND (h.next_session IS NULL OR m.d < h.next_session) WHERE h.shares <> 0),
    marked AS (SELECT s.*, CASE WHEN b.d >= s.d - {PRICE_DAYS} THEN CAST(b.close AS DECIMAL(18,9)) END AS mark
               FROM spans s ASOF LEFT JOIN bars b ON b.ticker = s.ticker AND b.d <= s.d),
    v AS (SELECT fund, d, sum(shares * mark) AS value, count(*) AS n_held, count(*) FILTER (WHERE mark IS NULL) AS n_unpriced FROM marked GROUP BY 1, 2)
    SELECT c.fund, c.session, c.cash, CAST(c.exact_cash + coalesce(v.value, 0) AS DOUBLE) AS nav, coalesce(v.n_held, 0) AS n_held,
           coalesce(v.n_unpriced, 0) AS n_unpriced FROM cash c LEFT JOIN v ON v.fund = c.fund AND v.d = c.session""", "nav held bars market")
def daily_nav_tolerant(t):
    """A close counts for a week at most; names without one are counted, not valued."""
    return ledger.daily_nav(t.fills, t.closes, t.market.select("d"), F.lit(CAPITAL), tolerance=PRICE_DAYS)


@query("unpriced_stretches", f"""
    WITH horizon AS (SELECT max(d) AS d FROM market),
    spans AS (SELECT h.fund, h.ticker, CAST(h.shares AS BIGINT) AS shares, h.session, coalesce(h.next_session - 1, z.d) AS until
              FROM held h, horizon z WHERE h.shares <> 0 AND h.session <= coalesce(h.next_session - 1, z.d)),
    days AS (SELECT fund, ticker, shares, session, CAST(unnest(generate_series(session, until, INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
    bare AS (SELECT s.* FROM days s ASOF LEFT JOIN bars b ON b.ticker = s.ticker AND b.d <= s.day WHERE b.d IS NULL OR b.d < s.day - {PRICE_DAYS}),
    islands AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY fund, ticker, session ORDER BY day) AS INTEGER) AS island FROM bare)
    SELECT i.fund, i.ticker, i.shares, min(i.day) AS first, max(i.day) AS last, count(m.d) AS n_sessions
    FROM islands i LEFT JOIN market m ON m.d = i.day GROUP BY i.fund, i.ticker, i.shares, i.session, i.island HAVING count(m.d) > 0""", "held bars market")
def unpriced_stretches(t):
    """Where positions are held without a close of the last seven days."""
    return ledger.unpriced_stretches(t.fills, t.closes, t.market.select("d"), tolerance=PRICE_DAYS)


@query("cycle_accounting", """
    WITH flows AS (SELECT fund, session, ticker, CAST(sum(CASE side WHEN 'buy' THEN quantity ELSE -quantity END) AS BIGINT) AS moved,
        sum(CASE side WHEN 'buy' THEN -quantity ELSE quantity END * price) AS cash, count(*) AS n FROM fills GROUP BY 1, 2, 3),
    marked AS (SELECT f.*, coalesce(CAST(b.close AS DECIMAL(18,9)), 0) AS mark FROM flows f ASOF LEFT JOIN bars b ON b.ticker = f.ticker AND b.d <= f.session),
    days AS (SELECT fund, session, sum(cash) AS cash, sum(moved * mark) AS bought, CAST(sum(n) AS BIGINT) AS n_fills FROM marked GROUP BY 1, 2)
    SELECT n.fund, n.session, CAST(n.exact_cash - d.cash AS DOUBLE) AS cash_before, n.cash AS cash_after,
           CAST(n.exact_nav - d.bought - d.cash AS DOUBLE) AS equity_before, n.nav AS nav_after, d.n_fills,
           n.n_held AS n_positions
    FROM nav n JOIN days d ON d.fund = n.fund AND d.session = n.session""", "nav fills bars")
def cycle_accounting(t):
    return ledger.cycle_accounting(t.fills, t.closes, t.market.select("d"), F.lit(CAPITAL))


QUARTERS_SQL = """
    ends AS (SELECT max(d) AS d FROM market GROUP BY year(d), quarter(d)),
    periods AS (SELECT d AS start, lead(d) OVER (ORDER BY d) AS "end" FROM ends QUALIFY "end" IS NOT NULL)"""


def periods(t):
    ends = t.market.groupBy(F.trunc("d", "quarter").alias("_q")).agg(F.max("d").alias("d")).select("d")
    return funds.next_session(ends).where("next_session IS NOT NULL").select(
        F.col("d").alias("start"), F.col("next_session").alias("end")
    )


@query("rebalanced_nav", f"""
    WITH {QUARTERS_SQL},
    w AS (SELECT 'RB' AS fund, start, "end", 'S' || s_suppkey AS ticker,
            ((s_suppkey * 7 + month(start)) % 11 - 3) / (3.0::DOUBLE * (SELECT n FROM n_sup)) AS weight FROM supplier, periods),
    days AS (SELECT unnest(generate_series(start + 1, "end", INTERVAL 1 DAY))::DATE AS as_of, start, "end" FROM periods),
    tame AS (SELECT ticker, d, 1000 + close % 100 AS close FROM bars),
    based AS (SELECT w.*, b.close AS base FROM w ASOF JOIN tame b ON b.ticker = w.ticker AND b.d <= w.start WHERE b.d >= w.start - 30),
    asked AS (SELECT x.*, d.as_of FROM based x JOIN days d ON d.start = x.start),
    priced AS (SELECT a.*, b.close FROM asked a ASOF JOIN tame b ON b.ticker = a.ticker AND b.d <= a.as_of WHERE b.d >= a.as_of - 30),
    f AS (SELECT fund, start, "end", as_of, 1 + sum(weight * (close / base - 1)) AS f FROM priced GROUP BY 1, 2, 3, 4)
    SELECT fund, as_of AS session, round(exp(coalesce(sum(CASE WHEN as_of = "end" THEN ln(f) END)
      OVER (PARTITION BY fund ORDER BY as_of ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * f, 6) AS nav FROM f""",
    "n_sup market bars")
def rebalanced_nav(t):
    spans = periods(t)
    code = F.col("s_suppkey") * 7 + F.month("start")
    starts = asof.on_dates(t.table("supplier").select("s_suppkey"), spans, "start")
    weights = starts.select(
        F.lit("RB").alias("fund"), "start", F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"),
        ((code % 11 - 3) / (F.lit(3.0) * t.n_tickers)).alias("weight"),
    )
    # Test prices jump by factors; folding them into a band keeps a levered book solvent.
    tame = t.closes.withColumn("close", 1000 + F.col("close") % 100)
    marks = asof.carry_forward(tame, ["ticker"], "d", tolerance=30).select("ticker", "as_of", "close")
    return rounded(ledger.rebalanced_nav(weights, marks, spans), "nav")


def with_benchmark(t):
    bench = t.market.select(F.col("d").alias("session"), F.col("close").alias("_c"))
    base = t.market.agg(F.min_by("close", "d")).scalar()
    return nav(t).join(F.broadcast(bench), "session").withColumn(
        "benchmark_nav", F.lit(CAPITAL) * F.col("_c") / base
    )


PERF_SQL = """
    curve AS (SELECT n.fund, n.session, n.nav, 100000000.0::DOUBLE * m.close / (SELECT arg_min(close, d) FROM market) AS benchmark_nav
              FROM nav n JOIN market m ON m.d = n.session),
    steps AS (SELECT *, nav / lag(nav) OVER w - 1 AS r, max(nav) OVER w AS peak FROM curve WINDOW w AS (PARTITION BY fund ORDER BY session))"""


@query("fund_metrics", f"""
    WITH {PERF_SQL},
    s AS (SELECT fund, arg_max(nav, session) / 100000000.0 - 1 AS total, arg_max(benchmark_nav, session) / 100000000.0 - 1 AS bench,
            date_diff('day', min(session), max(session)) / 365.25::DOUBLE AS years, avg(r) AS mean, stddev_samp(r) AS std, count(r) AS n,
            max((peak - nav) / peak) AS dd, count(*) AS n_sessions FROM steps GROUP BY 1)
    SELECT s.fund, round(total, 6) AS total_return_pct, round(CASE WHEN years > 0 THEN pow(1 + total, 1 / years) - 1 ELSE 0 END, 6) AS annualized_return_pct,
           round(CASE WHEN n > 1 AND std > 0 THEN mean / std * sqrt(252) ELSE 0 END, 4) AS sharpe_ratio, round(dd, 6) AS max_drawdown_pct,
           round(bench, 6) AS benchmark_return_pct, round(total - bench, 6) AS excess_return_pct, n_sessions, f.n_cycles, f.n_orders
    FROM s LEFT JOIN (SELECT fund, count(DISTINCT session) AS n_cycles, count(*) AS n_orders FROM fills GROUP BY 1) f ON f.fund = s.fund""",
    "nav market fills")
def fund_metrics(t):
    per_day = t.fills.groupBy("fund", "session").agg(F.count("*").alias("_n"))
    activity = per_day.groupBy("fund").agg(F.count("*").alias("n_cycles"), F.sum("_n").alias("n_orders"))
    return funds.fund_metrics(with_benchmark(t), F.lit(CAPITAL), activity)


@query("expanding_metrics", f"""
    WITH {PERF_SQL},
    s AS (SELECT fund, session, nav / 100000000.0 - 1 AS total, benchmark_nav / 100000000.0 - 1 AS bench,
            date_diff('day', min(session) OVER w, session) / 365.25::DOUBLE AS years, avg(r) OVER w AS mean, stddev_samp(r) OVER w AS std,
            count(r) OVER w AS n, max((peak - nav) / peak) OVER w AS dd FROM steps WINDOW w AS (PARTITION BY fund ORDER BY session))
    SELECT fund, session, round(total, 6) AS total_return_pct,
           round(CASE WHEN n > 1 AND std > 0 THEN mean / std * sqrt(252) ELSE 0 END, 4) AS sharpe_ratio, round(dd, 6) AS max_drawdown_pct,
           round(bench, 6) AS benchmark_return_pct FROM s""", "nav market")
def expanding_metrics(t):
    return funds.expanding_fund_metrics(with_benchmark(t), F.lit(CAPITAL)).drop("annualized_return_pct")
