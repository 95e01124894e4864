"""Signal, snapshot and trade-study queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series, signals, snapshot, trades
from ..session import stored
from .q_reads import GRID_SQL, TOPN_SQL, ticker_grid
from .q_study import rounded
from .registry import query


@query("filter_labeled", """
    SELECT filing_id, ticker, source_type, eps_surprise FROM filings
    WHERE eps_surprise IN ('BEAT', 'MISS') AND source_type = '8-K'""", "filings")
def filter_labeled(t):
    return signals.labeled_only(t.filings, announcement_only=True).select(
        "filing_id", "ticker", "source_type", "eps_surprise"
    )


@query("filter_conviction", """
    SELECT ticker, date, model_name, value, CASE WHEN value > 0 THEN 'long' ELSE 'short' END AS direction
    FROM signals WHERE abs(value) > 0.5""", "signals")
def filter_conviction(t):
    return signals.conviction_filter(t.signals, 0.5).select("ticker", "date", "model_name", "value", "direction")


RANK_SQL = "CASE source_type WHEN '8-K' THEN 0 WHEN '10-Q' THEN 1 WHEN '10-K' THEN 2 WHEN '20-F' THEN 3 ELSE 99 END"


@query("best_filing_per_period", f"""
    SELECT ticker, report_period, filing_id, filing_date, source_type, eps_surprise FROM filings
    QUALIFY row_number() OVER (PARTITION BY ticker, report_period ORDER BY {RANK_SQL}, filing_date, filing_id) = 1
    """, "filings")
def best_filing_per_period(t):
    return signals.best_filing_per_period(t.filings)


PEAD_SQL = f"""
    best AS (SELECT * FROM timely WHERE eps_surprise IN ('BEAT', 'MISS') AND source_type = '8-K'
      QUALIFY row_number() OVER (PARTITION BY ticker, report_period ORDER BY {RANK_SQL}, filing_date, filing_id) = 1),
    per_day AS (SELECT * FROM best
      QUALIFY row_number() OVER (PARTITION BY ticker, filing_date ORDER BY report_period DESC, filing_id) = 1),
    pead AS (
      SELECT b.ticker, b.d, CASE WHEN p.filing_date >= b.d - 4 THEN CASE p.eps_surprise WHEN 'BEAT' THEN 1.0 ELSE -1.0 END
               ELSE 0.0 END::DOUBLE AS value,
             CASE WHEN p.filing_date >= b.d - 4 THEN p.filing_date END AS filing_date
      FROM bars b ASOF LEFT JOIN per_day p ON p.ticker = b.ticker AND p.filing_date <= b.d)"""


def pead_panel(t):
    grid = t.closes.select("ticker", F.col("d").alias("date"))
    return signals.surprise_signal(grid, t.filings)


@query("pead_signal", f"WITH {PEAD_SQL} SELECT 'pead' AS model_name, ticker, d AS date, value, false AS abstained, filing_date FROM pead",
       "timely bars")
def pead_signal(t):
    return pead_panel(t).select("model_name", "ticker", "date", "value", "abstained", "filing_date")


@query("signal_onset", f"""
    WITH {PEAD_SQL} SELECT ticker, d, value, value <> 0 AND coalesce(lag(value) OVER (PARTITION BY ticker ORDER BY d), 0) = 0
      AS onset FROM pead""", "timely bars")
def signal_onset(t):
    panel = pead_panel(t).select("ticker", F.col("date").alias("d"), "value")
    return series.onset(panel, F.col("value") != 0).select("ticker", "d", "value", "onset")


SNAP_SQL = f"""
    {GRID_SQL}, {TOPN_SQL},
    agg AS (
      SELECT ticker, as_of, count(*) AS n_periods,
             printf('%.4f', list_reduce(list(return_on_equity ORDER BY rank) FILTER (WHERE return_on_equity IS NOT NULL), lambda a, b: a + b)
               / count(return_on_equity))::DOUBLE AS roe_avg,
             printf('%.4f', list_reduce(list(net_margin ORDER BY rank), lambda a, b: a + b) / count(net_margin))::DOUBLE AS net_margin_avg,
             printf('%.4f', CASE WHEN count(gross_margin) >= 2 THEN arg_min(gross_margin, rank) - arg_max(gross_margin, rank) END)::DOUBLE
               AS gross_margin_trend,
             printf('%.4f', CASE WHEN count(book_value_per_share) >= 2 AND arg_min(book_value_per_share, rank) > 0 AND arg_max(book_value_per_share, rank) > 0
               THEN pow(arg_min(book_value_per_share, rank) / arg_max(book_value_per_share, rank), 1 / ((count(book_value_per_share) - 1) / 4)) - 1 END)::DOUBLE AS bvps_cagr,
             max(debt_to_equity) FILTER (WHERE rank = 1) AS debt_to_equity_latest,
             max(market_cap) FILTER (WHERE rank = 1) AS market_cap_latest
      FROM known GROUP BY 1, 2)"""


@query("snapshot_aggregates", f"WITH {SNAP_SQL} SELECT * FROM agg", "facts market metrics")
def snapshot_aggregates(t):
    return snapshot.snapshot_aggregates(snapshot.known_periods(ticker_grid(t), t.metrics))


@query("fundamentals_snapshot", f"""
    WITH {SNAP_SQL} SELECT a.*, f.sector, f.industry FROM agg a LEFT JOIN facts f ON f.ticker = a.ticker WHERE n_periods >= 4
    """, "facts market metrics")
def fundamentals_snapshot(t):
    return snapshot.fundamentals_snapshot(ticker_grid(t), t.metrics, t.facts)


@query("period_labels", f"""
    WITH {GRID_SQL}, {TOPN_SQL} SELECT ticker, as_of, filing_id, 't-' || (rank - 1) AS label FROM known""",
    "facts market metrics")
def period_labels(t):
    known = snapshot.known_periods(ticker_grid(t), t.metrics)
    return known.select("ticker", "as_of", "filing_id", snapshot.period_label(F.col("rank")).alias("label"))


@query("signals_by_key", """
    SELECT ticker, date, string_agg(model_name || '=' || k, ',' ORDER BY model_name) AS signals,
           round(avg(value), 6) AS composite_score FROM signals GROUP BY 1, 2""", "signals")
def signals_by_key(t):
    mapped = signals.signals_by_key(t.signals)
    entries = F.transform(
        F.array_sort(F.map_entries("signals")),
        lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 50 + 50, 0).cast("int").cast("string")),
    )
    flat = mapped.select("ticker", "date", F.array_join(entries, ",").alias("signals"), "composite_score")
    return rounded(flat, "composite_score")


@query("run_models", f"""
    WITH {PEAD_SQL},
    asked AS (SELECT DISTINCT ticker, date FROM signals),
    panels AS (
      SELECT 'pead' AS model_name, ticker, d AS date, value, false AS abstained FROM pead
      UNION ALL SELECT 'pead', ticker, date, 0.0, false FROM asked
      UNION ALL SELECT 'click', ticker, d, 0.0, true FROM pead
      UNION ALL SELECT 'click', a.ticker, a.date, coalesce(s.value, 0.0), coalesce(s.abstained, true)
        FROM asked a LEFT JOIN signals s ON s.ticker = a.ticker AND s.date = a.date AND s.model_name = 'click')
    SELECT p.model_name, p.ticker, p.date, p.value, p.abstained, m.approach
    FROM panels p JOIN (VALUES ('pead', 'long_short'), ('click', 'long_only')) m(model_name, approach) ON m.model_name = p.model_name
    """, "timely bars signals")
def run_models(t):
    """Two registered models, one by rule and one whose answers are a table, with their permissions."""
    signals.register(signals.answered_model("click", "long_only"))
    grid = t.closes.select("ticker", F.col("d").alias("date")).unionByName(t.signals.select("ticker", "date").distinct())
    tables = {"filings": t.filings, "click": t.signals.where("model_name = 'click'")}
    panels = signals.run_models(["pead", "click"], grid, tables).drop("reason")
    return panels.join(F.broadcast(signals.approaches(t.spark, ["pead", "click"])), "model_name")


def entry_panel(t):
    return pead_panel(t).select("ticker", F.col("date").alias("d"), "value")


# The day-by-day machine: one recursion step per trading day and ticker.
MACHINE_SQL = f"""
    {PEAD_SQL},
    days AS (
      SELECT ticker, d, value, row_number() OVER w - 1 AS i, lead(d, {{hold}}) OVER w AS exit_date
      FROM pead WINDOW w AS (PARTITION BY ticker ORDER BY d)),
    walk AS (
      SELECT ticker, CAST(-1 AS BIGINT) AS i, true AS armed, CAST(0 AS BIGINT) AS busy_until, false AS halted,
             CAST(NULL AS DATE) AS entry_date, CAST(0 AS DOUBLE) AS value
      FROM (SELECT DISTINCT ticker FROM days)
      UNION ALL
      SELECT w.ticker, d.i,
             CASE WHEN w.halted OR d.i < w.busy_until THEN w.armed
                  WHEN w.armed AND d.value <> 0 THEN false
                  WHEN d.value = 0 THEN true ELSE w.armed END,
             CASE WHEN NOT w.halted AND d.i >= w.busy_until AND w.armed AND d.value <> 0 THEN d.i + {{hold}} ELSE w.busy_until END,
             w.halted OR (d.i >= w.busy_until AND w.armed AND d.value <> 0 AND d.exit_date IS NULL),
             CASE WHEN NOT w.halted AND d.i >= w.busy_until AND w.armed AND d.value <> 0 AND d.exit_date IS NOT NULL THEN d.d END,
             d.value
      FROM walk w JOIN days d ON d.ticker = w.ticker AND d.i = w.i + 1),
    entries AS (SELECT ticker, entry_date, value FROM walk WHERE entry_date IS NOT NULL)"""
TRADES_SQL = """
    priced AS (
      SELECT ticker, d, close, lead(d, {hold}) OVER w AS exit_date, lead(close, {hold}) OVER w AS exit_price
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY d)),
    trades AS (
      SELECT e.ticker, CASE WHEN e.value > 0 THEN 'long' ELSE 'short' END AS direction, e.entry_date, p.exit_date,
             p.close AS entry_price, p.exit_price, round(10000.0::DOUBLE / p.close, 4) AS shares,
             round(10000.0::DOUBLE / p.close * (CASE WHEN e.value > 0 THEN p.exit_price - p.close ELSE p.close - p.exit_price END), 2) AS pnl,
             round((CASE WHEN e.value > 0 THEN p.exit_price - p.close ELSE p.close - p.exit_price END) / p.close, 6) AS return_pct,
             CAST({hold} AS BIGINT) AS holding_days
      FROM entries e JOIN priced p ON p.ticker = e.ticker AND p.d = e.entry_date)"""
CURVE_SQL = """
    curve AS (
      SELECT *, round(greatest(100000.0::DOUBLE, max(equity) OVER w), 2) AS peak,
             row_number() OVER w AS n FROM (
        SELECT *, round(100000.0::DOUBLE + CAST(sum(CAST(pnl AS DECIMAL(18,2))) OVER (ORDER BY entry_date, ticker) AS DOUBLE), 2) AS equity
        FROM trades) WINDOW w AS (ORDER BY entry_date, ticker))"""


@query("non_overlapping_entries", f"WITH RECURSIVE {MACHINE_SQL.format(hold=5)} SELECT ticker, entry_date, value FROM entries",
       "timely bars")
def non_overlapping_entries(t):
    return trades.non_overlapping_entries(entry_panel(t), hold=5)


@query("fixed_hold_trades", f"""
    WITH RECURSIVE {MACHINE_SQL.format(hold=5)}, {TRADES_SQL.format(hold=5)}
    SELECT ticker, direction, entry_date, exit_date, entry_price, exit_price, shares, pnl, return_pct, holding_days FROM trades
    """, "timely bars")
def fixed_hold_trades(t):
    return trades.fixed_hold_trades(trades.non_overlapping_entries(entry_panel(t), hold=5), t.closes, hold=5)


def trade_table(t):
    """The trades as a stored table: curve and metrics read them several times."""
    return stored(fixed_hold_trades(t), "trades")


@query("sort_trades", f"""
    WITH RECURSIVE {MACHINE_SQL.format(hold=5)}, {TRADES_SQL.format(hold=5)}
    SELECT ticker, entry_date, row_number() OVER (ORDER BY entry_date, ticker) AS seq FROM trades""", "timely bars")
def sort_trades(t):
    ordered = trades.number_trades(trade_table(t).withColumn("study", F.lit("pead")), ["study"])
    return ordered.select("ticker", "entry_date", "seq").orderBy("entry_date", "ticker")


@query("equity_curve", f"""
    WITH RECURSIVE {MACHINE_SQL.format(hold=5)}, {TRADES_SQL.format(hold=5)}, {CURVE_SQL}
    SELECT ticker, entry_date, equity, peak, round((peak - equity) / peak, 6) AS drawdown FROM curve
    UNION ALL SELECT NULL, NULL, 100000.0::DOUBLE, 100000.0::DOUBLE, 0.0::DOUBLE""", "timely bars")
def equity_curve(t):
    traded = trade_table(t).withColumn("study", F.lit("pead"))
    curve = trades.equity_curve(traded, ["study"]).select("study", "ticker", "entry_date", "equity", "peak", "drawdown")
    started = trades.with_start(curve, ["study"])
    return rounded(started.drop("study"), "drawdown")


METRIC_SQL = """
    SELECT CAST({hold} AS BIGINT) AS holding_days, printf('%.6f', total)::DOUBLE AS total_return_pct,
           round(pow(1 + total, 1 / years) - 1, 6) AS annualized_return_pct,
           round(CASE WHEN n > 1 AND std = 0 THEN 0 ELSE mean / CASE WHEN n > 1 THEN std ELSE 1 END * sqrt(n / years) END, 4) AS sharpe_ratio,
           round(greatest(dd, 0), 6) AS max_drawdown_pct, printf('%.4f', wins / n)::DOUBLE AS win_rate, n AS n_trades, n_long, n_short,
           printf('%.6f', mean)::DOUBLE AS avg_return_pct, round(hold, 1) AS avg_holding_days
    FROM (SELECT (arg_max(equity, n) - 100000) / 100000 AS total,
                 greatest(date_diff('day', min(entry_date), arg_max(exit_date, n)) / 365.25::DOUBLE, 0.01) AS years,
                 count(*) AS n, sum(CAST(return_pct AS DECIMAL(18,6)))::DOUBLE / count(*) AS mean, stddev_samp(return_pct) AS std, max((peak - equity) / peak) AS dd,
                 count(*) FILTER (WHERE return_pct > 0) AS wins, count(*) FILTER (WHERE direction = 'long') AS n_long,
                 count(*) FILTER (WHERE direction = 'short') AS n_short, avg(holding_days) AS hold FROM curve)"""


@query("trade_metrics", f"""
    WITH RECURSIVE {MACHINE_SQL.format(hold=5)}, {TRADES_SQL.format(hold=5)}, {CURVE_SQL} {METRIC_SQL.format(hold=5)}
    """, "timely bars")
def trade_metrics(t):
    return trades.trade_metrics(trade_table(t), ["holding_days"])


@query("expanding_trade_metrics", f"""
    WITH RECURSIVE {MACHINE_SQL.format(hold=5)}, {TRADES_SQL.format(hold=5)}, {CURVE_SQL},
    e AS (SELECT ticker, entry_date, n, equity, (equity - 100000) / 100000 AS total,
            greatest(date_diff('day', min(entry_date) OVER w, exit_date) / 365.25::DOUBLE, 0.01) AS years,
            CAST(sum(CAST(return_pct AS DECIMAL(18,6))) OVER w AS DOUBLE) / n AS mean, stddev_samp(return_pct) OVER w AS std, max((peak - equity) / peak) OVER w AS dd,
            count(*) FILTER (WHERE return_pct > 0) OVER w AS wins
          FROM curve WINDOW w AS (ORDER BY n))
    SELECT ticker, entry_date, n AS n_trades, equity, printf('%.6f', total)::DOUBLE AS total_return_pct,
           round(CASE WHEN n > 1 AND std = 0 THEN 0 ELSE mean / CASE WHEN n > 1 THEN std ELSE 1 END * sqrt(n / years) END, 4) AS sharpe_ratio,
           round(greatest(dd, 0), 6) AS max_drawdown_pct, printf('%.4f', wins / n)::DOUBLE AS win_rate, printf('%.6f', mean)::DOUBLE AS avg_return_pct
    FROM e""", "timely bars")
def expanding_trade_metrics(t):
    run = trades.expanding_trade_metrics(trade_table(t), ["holding_days"])
    return run.drop("holding_days", "annualized_return_pct")


HOLDS, THRESHOLDS = (3, 10), (0.0, 0.5)


def _study_sql():
    parts = []
    for h in HOLDS:
        for x in THRESHOLDS:
            machine = MACHINE_SQL.format(hold=h).replace("d.value <> 0", f"abs(d.value) > {x}").replace("d.value = 0", f"abs(d.value) <= {x}")
            parts.append(f"SELECT *, CAST({x} AS DOUBLE) AS threshold FROM (WITH RECURSIVE {machine}, {TRADES_SQL.format(hold=h)}, {CURVE_SQL} "
                         f"{METRIC_SQL.format(hold=h)})")
    return " UNION ALL ".join(parts)


@query("trade_study", _study_sql(), "timely bars")
def trade_study(t):
    traded = stored(trades.trade_study(entry_panel(t), t.closes, holds=HOLDS, thresholds=THRESHOLDS), "trades")
    return trades.trade_metrics(traded, ["holding_days", "threshold"])
