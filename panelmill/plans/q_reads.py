"""Point-in-time reads and as-of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, checks, eventstudy, funds, orders, signals, snapshot
from ..session import scratch_path
from ..sources import reads, receipts
from .registry import query

AS_OF = "2000-06-30"
MONTH_ENDS = "SELECT max(d) AS as_of FROM market GROUP BY year(d), month(d)"


def ticker_grid(t):
    """Every ticker on every month-end session."""
    month_ends = t.market.groupBy(F.trunc("d", "MM").alias("_m")).agg(F.max("d").alias("as_of")).select("as_of")
    return asof.on_dates(t.facts.select("ticker"), month_ends, "as_of")


GRID_SQL = f"grid AS (SELECT ticker, as_of FROM facts CROSS JOIN ({MONTH_ENDS}))"


@query("scan_bars", """
    SELECT ticker, d, close, high, low, volume FROM bars
    WHERE d BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'
      AND ticker IN (SELECT ticker FROM facts WHERE sector = 'ASIA')""", "bars facts")
def scan_bars(t):
    wanted = t.facts.where("sector = 'ASIA'").select("ticker")
    bars = t.bars.select("ticker", "d", "close", "high", "low", "volume")
    return reads.scan_bars(bars, "1999-01-01", "1999-12-31", wanted)


@query("resample_bars", """
    SELECT 'U' || user_id AS ticker, time_bucket(INTERVAL 4 HOUR, ts) AS bar, arg_min(value, (ts, event_id)) AS open,
           max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
    FROM events GROUP BY 1, 2""")
def resample_bars(t):
    ticks = t.table("events").select(
        F.concat(F.lit("U"), F.col("user_id")).alias("ticker"), "ts", "event_id",
        F.col("value").alias("price"), F.lit(1).cast("bigint").alias("volume"),
    )
    bars = reads.resample_bars(ticks, "hour", 4, tie="event_id")
    return bars.withColumn("bar", F.col("bar").cast("timestamp_ntz"))


@query("resample_bars_monthly", """
    SELECT ticker, CAST(date_trunc('quarter', d) AS DATE) AS bar, arg_min(close, d) AS open, max(close) AS high,
           min(close) AS low, arg_max(close, d) AS close, CAST(sum(volume) AS BIGINT) AS volume
    FROM bars GROUP BY 1, 2""", "bars")
def resample_bars_monthly(t):
    ticks = t.bars.select("ticker", "d", F.col("close").alias("price"), "volume")
    return reads.resample_bars(ticks, "quarter", tie="d", when="d")


@query("scan_fundamentals_pit", f"""
    SELECT filing_id, ticker, filing_date, report_period, market_cap, net_margin FROM metrics
    WHERE filing_date <= DATE '{AS_OF}' AND period = 'ttm'
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, report_period DESC, filing_id DESC) <= 10
    """, "metrics")
def scan_fundamentals_pit(t):
    return reads.filed_metrics(t.metrics, AS_OF).select(
        "filing_id", "ticker", "filing_date", "report_period", "market_cap", "net_margin"
    )


@query("scan_news", """
    SELECT doc_id, ticker, title, text, source, date FROM news WHERE date BETWEEN DATE '2024-03-01' AND DATE '2024-10-31'
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC, doc_id DESC) <= 3""", "news")
def scan_news(t):
    return reads.dated_facts(t.news, "date", "2024-10-31", "2024-03-01", limit=3, tie="doc_id")


@query("scan_insider", f"""
    SELECT ticker, filing_date, order_id, transaction_shares, transaction_value FROM insider
    WHERE filing_date <= DATE '{AS_OF}'
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, order_id DESC) <= 50""", "insider")
def scan_insider(t):
    return reads.dated_facts(t.insider, "filing_date", AS_OF, limit=50, tie="order_id")


@query("dim_facts", """
    SELECT f.filing_id, f.ticker, d.name, d.sector, d.industry FROM filings f LEFT JOIN facts d ON d.ticker = f.ticker
    """, "filings facts")
def dim_facts(t):
    return reads.with_facts(t.filings.select("filing_id", "ticker"), t.facts).select(
        "filing_id", "ticker", "name", "sector", "industry"
    )


@query("join_sector", """
    SELECT b.ticker, b.d, f.sector, f.industry FROM bars b LEFT JOIN facts f ON f.ticker = b.ticker""", "bars facts")
def join_sector(t):
    return reads.with_facts(t.closes.select("ticker", "d"), t.facts).select("ticker", "d", "sector", "industry")


@query("latest_earnings", """
    SELECT filing_id, ticker, filing_date, report_period, source_type, eps_surprise FROM filings
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY report_period DESC, filing_date DESC, filing_id DESC) = 1
    """, "filings")
def latest_earnings(t):
    return reads.latest_earnings(t.filings)


@query("earnings_history", """
    SELECT filing_id, ticker, filing_date, report_period, source_type, eps_surprise FROM filings
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, filing_id DESC) <= 12""", "filings")
def earnings_history(t):
    return reads.newest_per_ticker(t.filings, 12, ["filing_date", "filing_id"], salt_by="filing_id")


@query("topn_per_key", """
    SELECT ticker, filing_id, filing_date, n FROM (
      SELECT ticker, filing_id, filing_date, n,
             row_number() OVER (PARTITION BY ticker, n ORDER BY filing_date DESC, filing_id DESC) AS rn
      FROM filings, (VALUES (1), (8), (20)) v(n)) WHERE rn <= n""", "filings")
def topn_per_key(t):
    out = None
    for n in (1, 8, 20):
        part = reads.newest_per_ticker(
            t.filings.select("ticker", "filing_id", "filing_date"), n, ["filing_date", "filing_id"]
        ).withColumn("n", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


@query("market_cap_asof", f"""
    SELECT ticker, arg_max(market_cap, (filing_date, report_period, filing_id)) AS market_cap FROM metrics
    WHERE filing_date <= DATE '{AS_OF}' GROUP BY 1""", "metrics")
def market_cap_asof(t):
    return reads.market_cap_asof(t.metrics, AS_OF)


@query("session_calendar", """
    SELECT d, close FROM market WHERE d BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""", "market")
def session_calendar(t):
    return reads.session_closes(t.market, "MKT", "1996-01-01", "2000-12-31")


@query("normalize_universe", """
    SELECT ticker, min(pos) AS pos FROM (
      SELECT upper(trim(CASE WHEN event_id % 5 = 0 THEN '  ' ELSE ' u' || user_id || ' ' END)) AS ticker, event_id AS pos
      FROM events) WHERE ticker <> '' GROUP BY 1""")
def normalize_universe(t):
    typed = t.table("events").select(
        F.when(F.col("event_id") % 5 == 0, "  ")
        .otherwise(F.concat(F.lit(" u"), F.col("user_id"), F.lit(" "))).alias("ticker"),
        F.col("event_id").alias("pos"),
    )
    return reads.normalize_universe(typed)


@query("filter_completed_days", "SELECT ticker, d, close FROM bars WHERE d <= DATE '2000-06-13'", "bars")
def filter_completed_days(t):
    now = F.to_timestamp(F.lit("2000-06-15 03:00:00"))  # still June 14 in New York
    return reads.completed_days(t.closes, now).select("ticker", "d", "close")


@query("only_new_work", """
    WITH requests AS (SELECT DISTINCT 'U' || user_id AS ticker, CAST(ts AS DATE) AS end_date FROM events),
    done AS (SELECT ticker, end_date FROM (
      SELECT 'U' || user_id AS ticker, CAST(ts AS DATE) AS end_date,
             max(ts + INTERVAL 14 HOUR) AS fetched_at FROM events WHERE event_type = 'view' GROUP BY 1, 2)
      WHERE CAST(fetched_at - INTERVAL 5 HOUR AS DATE) > end_date)
    SELECT ticker, end_date FROM requests r
    WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.ticker = r.ticker AND d.end_date = r.end_date)""")
def only_new_work(t):
    # All events fall in winter, when New York is five hours behind UTC.
    keyed_events = t.table("events").select(
        F.concat(F.lit("U"), F.col("user_id")).alias("ticker"), F.col("ts").cast("date").alias("end_date"), "ts", "event_type"
    )
    requests = keyed_events.select("ticker", "end_date").distinct()
    done = keyed_events.where("event_type = 'view'").groupBy("ticker", "end_date").agg(
        F.max(F.col("ts").cast("timestamp") + F.expr("INTERVAL 14 HOURS")).alias("fetched_at")
    )
    return reads.only_new_work(requests, done, ["ticker", "end_date"])


@query("filter_retrospective", """
    SELECT filing_id, ticker, date_diff('day', report_period, filing_date) AS lag FROM timely""", "timely")
def filter_retrospective(t):
    kept = eventstudy.drop_retrospective(t.filings)
    return kept.select(
        "filing_id", "ticker", F.datediff("filing_date", "report_period").cast("bigint").alias("lag")
    )


@query("project_periods", """
    SELECT ticker, report_period, filing_date, market_cap, CAST(NULL AS DOUBLE) AS price_to_earnings_ratio, return_on_equity,
           gross_margin, CAST(NULL AS DOUBLE) AS operating_margin, net_margin, debt_to_equity,
           CAST(NULL AS DOUBLE) AS current_ratio, CAST(NULL AS DOUBLE) AS revenue_growth,
           CAST(NULL AS DOUBLE) AS earnings_per_share, book_value_per_share,
           CAST(NULL AS DOUBLE) AS free_cash_flow_per_share FROM metrics""", "metrics")
def project_periods(t):
    return snapshot.project_periods(t.metrics)


TOPN_SQL = """
    known AS (
      SELECT g.ticker, g.as_of, m.* EXCLUDE (ticker),
             row_number() OVER (PARTITION BY g.ticker, g.as_of ORDER BY m.filing_date DESC, m.report_period DESC, m.filing_id DESC) AS rank
      FROM grid g JOIN metrics m ON m.ticker = g.ticker AND m.filing_date <= g.as_of
      QUALIFY rank <= 20)"""


@query("join_pit_topn", f"WITH {GRID_SQL}, {TOPN_SQL} SELECT ticker, as_of, rank, filing_id, filing_date FROM known",
       "facts market metrics")
def join_pit_topn(t):
    known = snapshot.known_periods(ticker_grid(t), t.metrics)
    return known.select("ticker", "as_of", F.col("rank").cast("bigint").alias("rank"), "filing_id", "filing_date")


@query("min_history_gate", f"""
    WITH {GRID_SQL}, {TOPN_SQL}, n AS (SELECT ticker, as_of, count(*) AS n FROM known GROUP BY 1, 2)
    SELECT g.ticker, g.as_of, coalesce(n.n, 0) AS n_periods,
           CASE WHEN coalesce(n.n, 0) < 4 THEN 'too few filed periods' END AS reason
    FROM grid g LEFT JOIN n ON n.ticker = g.ticker AND n.as_of = g.as_of""", "facts market metrics")
def min_history_gate(t):
    grid = ticker_grid(t)
    return snapshot.gate_periods(grid, snapshot.known_periods(grid, t.metrics)).select(
        "ticker", "as_of", "n_periods", "reason"
    )


MARK_SQL = """
    marked AS (SELECT g.ticker, g.as_of, b.d AS mark_day, b.close FROM grid g ASOF LEFT JOIN bars b
               ON b.ticker = g.ticker AND b.d <= g.as_of)"""


@query("join_mark_lookback", f"""
    WITH {GRID_SQL}, {MARK_SQL}
    SELECT ticker, as_of, CASE WHEN mark_day >= as_of - 7 THEN mark_day END AS d,
           CASE WHEN mark_day >= as_of - 7 THEN close END AS close,
           CASE WHEN mark_day >= as_of - 7 THEN NULL ELSE 'no close within 7 days of ' || as_of END AS reason
    FROM marked""", "facts market bars")
def join_mark_lookback(t):
    marked = asof.asof_backward(ticker_grid(t), t.closes, ["ticker"], "d", tolerance=7)
    reason = F.when(F.col("d").isNull(), F.concat(F.lit("no close within 7 days of "), F.col("as_of").cast("string")))
    return marked.select("ticker", "as_of", "d", "close", reason.alias("reason"))


@query("split_tradeable", f"""
    WITH {GRID_SQL}, {MARK_SQL}
    SELECT ticker, as_of, mark_day IS NOT NULL AND mark_day >= as_of - 7 AS tradeable FROM marked""",
    "facts market bars")
def split_tradeable(t):
    known = asof.carry_forward(t.closes, ["ticker"], "d", tolerance=7)
    kept, skipped = orders.split_tradeable(ticker_grid(t), known)
    return kept.withColumn("tradeable", F.lit(True)).unionByName(
        skipped.drop("reason").withColumn("tradeable", F.lit(False))
    )


@query("join_exact_marks", f"""
    WITH {GRID_SQL}
    SELECT g.ticker, g.as_of AS session, b.close AS mark, CASE WHEN b.close IS NULL THEN 'missing close' END AS reason
    FROM grid g LEFT JOIN bars b ON b.ticker = g.ticker AND b.d = g.as_of""", "facts market bars")
def join_exact_marks(t):
    needed = ticker_grid(t).withColumnRenamed("as_of", "session")
    return orders.exact_marks(needed, t.closes).select("ticker", "session", "mark", "reason")


@query("basket_marks", f"""
    WITH {GRID_SQL},
    marked AS (SELECT g.ticker, g.as_of AS session, CAST(substr(g.ticker, 2) AS BIGINT) // 2 AS basket, b.close AS mark
               FROM grid g LEFT JOIN bars b ON b.ticker = g.ticker AND b.d = g.as_of),
    sized AS (SELECT *, count(*) FILTER (WHERE mark IS NULL) OVER (PARTITION BY basket, session) AS n_unusable FROM marked)
    SELECT basket, session, ticker, CASE WHEN n_unusable = 0 THEN mark END AS mark, CASE WHEN mark IS NULL THEN 'missing close' END AS reason,
           n_unusable, CASE WHEN n_unusable > 0 THEN 'missing close' END AS basket_reason FROM sized""", "facts market bars")
def basket_marks(t):
    """Baskets of two names at month ends: one without a close fails both."""
    needed = ticker_grid(t).withColumnRenamed("as_of", "session")
    needed = needed.withColumn("basket", F.floor(F.substring("ticker", 2, 20).cast("bigint") / 2))
    marked = orders.basket_marks(orders.exact_marks(needed, t.closes), ["basket", "session"])
    return marked.select("basket", "session", "ticker", "mark", "reason", "n_unusable", "basket_reason")


@query("join_pit_latest_filing", f"""
    WITH {GRID_SQL}, latest AS (
      SELECT ticker, filing_date, max(filing_id) AS filing_id FROM timely GROUP BY 1, 2)
    SELECT g.ticker, g.as_of, CASE WHEN f.filing_date >= g.as_of - 4 THEN f.filing_date END AS filing_date,
           CASE WHEN f.filing_date >= g.as_of - 4 THEN f.filing_id END AS filing_id
    FROM grid g ASOF LEFT JOIN latest f ON f.ticker = g.ticker AND f.filing_date <= g.as_of""",
    "facts market timely")
def join_pit_latest_filing(t):
    timely = eventstudy.drop_retrospective(t.filings)
    per_day = timely.groupBy("ticker", "filing_date").agg(F.max("filing_id").alias("filing_id"))
    joined = asof.asof_backward(ticker_grid(t), per_day, ["ticker"], "filing_date", tolerance=4)
    return joined.select("ticker", "as_of", "filing_date", "filing_id")


@query("join_next_session", """
    SELECT d, lead(d) OVER (ORDER BY d) AS next_session FROM market""", "market")
def join_next_session(t):
    return funds.next_session(t.market.select("d"))


@query("cross_grid", """
    SELECT f.ticker, m.strategy, m.model_name, s.as_of FROM facts f, models m, (SELECT max(d) AS as_of FROM market
    GROUP BY year(d), month(d)) s""", "facts models market")
def cross_grid(t):
    return signals.request_grid(ticker_grid(t), t.models.select("strategy", "model_name"))


@query("assert_rows", """
    SELECT ticker, d, 'close above 2000' AS rule FROM bars WHERE NOT close <= 2000
    UNION ALL SELECT ticker, d, 'range under 1200' FROM bars WHERE NOT high - low < 1200
    UNION ALL SELECT ticker, d, 'volume at least 5' FROM bars WHERE NOT volume >= 5""", "bars")
def assert_rows(t):
    rules = {
        "close above 2000": F.col("close") <= 2000,
        "range under 1200": F.col("high") - F.col("low") < 1200,
        "volume at least 5": F.col("volume") >= 5,
    }
    return checks.violations(t.bars, rules, ["ticker", "d"])


@query("set_equality", """
    SELECT d, 'left' AS side FROM (SELECT filing_date AS d FROM filings EXCEPT SELECT d FROM market)
    UNION ALL
    SELECT d, 'right' FROM (SELECT d FROM market EXCEPT SELECT filing_date FROM filings)
    """, "filings market")
def set_equality(t):
    filed = t.filings.select(F.col("filing_date").alias("d")).distinct()
    return checks.set_difference(filed, t.market.select("d"))


# Receipts: one JSON document per order, as a run, a backtest, a proposal, or damaged text.
def receipt_texts(t):
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    day = F.col("o_orderdate").cast("date").cast("string")
    universe = F.when(key % 3 == 0, "[]").otherwise(
        F.concat(F.lit('["S'), F.col("o_custkey") % 50, F.lit('", "S'), key % 50, F.lit('"]'))
    )
    backtest = F.concat(
        F.lit('{"universe": '), universe, F.lit(', "benchmark": "MKT", "metrics": {"total_return_pct": '),
        (key % 41).cast("string"), F.lit(', "annualized_return_pct": '), (key % 7).cast("string"),
        F.lit(', "sharpe_ratio": 1.5, "max_drawdown_pct": '), (key % 5).cast("string"), F.lit(', "benchmark_return_pct": '),
        (key % 3).cast("string"), F.lit(', "n_cycles": '), (key % 90).cast("string"),
        F.lit(', "excess_return_pct": '), (key % 17).cast("string"), F.lit('}, "start": "2000-01-03", "end": "'), day, F.lit('"}'),
    )
    pending = F.concat(
        F.lit('{"status": "pending", "as_of": "'), day, F.lit('", "reason": "no session", "proposal": {"universe": '),
        universe, F.lit("}}"),
    )
    run = F.concat(
        F.lit('{"as_of": "'), day, F.lit('", "universe": '), universe, F.lit(', "nav": '), price,
        F.lit(', "orders": [{"ticker": "A"}, {"ticker": "B"}]}'),
    )
    body = (
        F.when(key % 16 == 3, '{"universe": []}').when(key % 16 == 7, "[1, 2]").when(key % 4 == 0, backtest).when(key % 4 == 1, pending).when(key % 8 == 2, F.substring(run, 1, 25)).otherwise(run)
    )
    return t.table("orders").select(
        F.concat(F.lit("F"), F.col("o_custkey") % 10).alias("fund"), key.alias("receipt_id"),
        F.col("o_orderdate").cast("date").alias("mtime"), body.alias("body"),
    )


RECEIPT_SQL = """
    docs AS (
      SELECT 'F' || (o_custkey % 10) AS fund, o_orderkey AS receipt_id, CAST(o_orderdate AS DATE) AS mtime,
             CASE WHEN o_orderkey % 4 = 0 THEN 'backtest' WHEN o_orderkey % 4 = 1 THEN 'pending' ELSE 'run' END AS kind,
             CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE ['S' || (o_custkey % 50), 'S' || (o_orderkey % 50)] END AS universe,
             CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS as_of,
             CASE WHEN o_orderkey % 4 > 1 THEN o_totalprice END AS nav,
             CASE WHEN o_orderkey % 4 > 1 THEN 2 END AS n_orders,
             CASE WHEN o_orderkey % 4 = 1 THEN 'no session' END AS reason,
             CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 41 AS DOUBLE) END AS total,
             CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 17 AS DOUBLE) END AS excess,
             CASE WHEN o_orderkey % 4 = 0 THEN 'MKT' END AS benchmark,
             CASE WHEN o_orderkey % 4 = 0 THEN '2000-01-03' END AS start,
             CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS "end",
             CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 7 AS DOUBLE) END AS annualized,
             CASE WHEN o_orderkey % 4 = 0 THEN CAST(1.5 AS DOUBLE) END AS sharpe,
             CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 5 AS DOUBLE) END AS maxdd,
             CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 3 AS DOUBLE) END AS benchret,
             CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 90 END AS n_cycles
      FROM orders WHERE o_orderkey % 8 <> 2 AND o_orderkey % 16 NOT IN (3, 7))"""


def saved_receipts(t):
    """The documents as two runs committed them."""
    store = receipts.receipt_table(t.spark, scratch_path(t.spark, "receipts"))
    for batch, half in (("run-1", 0), ("run-2", 1)):
        store.append(receipt_texts(t).where(F.col("receipt_id") % 2 == half), batch)
    return store.rows().drop("batch")


@query("quarantined_receipts", """
    SELECT 'F' || (o_custkey % 10) AS fund, o_orderkey AS receipt_id,
           CASE WHEN o_orderkey % 16 = 3 THEN 'run lacks a field it needs' ELSE 'not a JSON object' END AS fault,
           CASE o_orderkey % 16 WHEN 3 THEN 16 WHEN 7 THEN 6 ELSE 25 END AS n_chars
    FROM orders WHERE o_orderkey % 8 = 2 OR o_orderkey % 16 IN (3, 7)""")
def quarantined_receipts(t):
    """Documents of the store that were cut short, are no object or lack a field, with the fault."""
    found = receipts.quarantined_receipts(saved_receipts(t))
    return found.select("fund", "receipt_id", "fault", F.length("body").alias("n_chars"))


@query("run_history", f"""
    WITH {RECEIPT_SQL}
    SELECT fund, receipt_id, mtime, kind, array_to_string(universe, ' ') AS universe, as_of, nav, n_orders, reason,
           start, "end", total, annualized, sharpe, maxdd, benchret, excess, n_cycles, benchmark FROM docs""")
def run_history(t):
    """Documents are committed to the store first and read back from it; damaged ones are left out."""
    found = receipts.summarize_receipts(saved_receipts(t)).drop("body")
    return found.withColumn("universe", F.array_join("universe", " ")).orderBy(F.col("mtime").desc(), F.col("receipt_id").desc())


@query("last_run_per_fund", f"""
    WITH {RECEIPT_SQL},
    named AS (SELECT fund, array_to_string(universe, ' ') AS universe FROM docs WHERE len(universe) > 0
              QUALIFY row_number() OVER (PARTITION BY fund ORDER BY mtime DESC, receipt_id DESC) = 1),
    scored AS (SELECT fund, total, excess, benchmark FROM docs WHERE kind = 'backtest'
              QUALIFY row_number() OVER (PARTITION BY fund ORDER BY mtime DESC, receipt_id DESC) = 1)
    SELECT fund, universe, total, excess, benchmark FROM named FULL JOIN scored USING (fund)""")
def last_run_per_fund(t):
    last = receipts.last_run_per_fund(receipts.summarize_receipts(saved_receipts(t)), tie="receipt_id")
    return last.withColumn("universe", F.array_join("universe", " "))


@query("write_receipts", """
    SELECT 'F' || (o_custkey % 10) AS fund, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders GROUP BY 1""")
def write_receipts(t):
    return saved_receipts(t).groupBy("fund").agg(F.count("*").alias("n"), F.sum("receipt_id").alias("ids"))
