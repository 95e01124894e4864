"""SQL views (as CTEs) over the driver tables for the independent SQL twins."""

from __future__ import annotations

from .datasets import FUND_CFG, MODEL_CFG, STRATEGY_CFG, duck

# name -> (views it reads, body)
VIEWS: dict[str, tuple[str, str]] = {
    "n_sup": ("", "SELECT count(*) AS n FROM supplier"),
    "bars": ("", """
        SELECT 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS d,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
                 / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close,
               max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS BIGINT) AS volume
        FROM lineitem GROUP BY 1, 2"""),
    "market": ("", """
        SELECT 'MKT' AS ticker, CAST(l_shipdate AS DATE) AS d,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
                 / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close
        FROM lineitem GROUP BY 2"""),
    "filings": ("n_sup", """
        SELECT o_orderkey AS filing_id, 'S' || (o_custkey % (SELECT n FROM n_sup)) AS ticker,
               CAST(o_orderdate AS DATE) AS filing_date,
               CAST(o_orderdate AS DATE) - CAST((o_orderkey * 7) % 91 AS INTEGER) AS report_period,
               CASE o_orderpriority WHEN '1-URGENT' THEN '8-K' WHEN '2-HIGH' THEN '10-Q'
                 WHEN '3-MEDIUM' THEN '10-K' WHEN '4-NOT SPECIFIED' THEN '20-F' ELSE '6-K' END AS source_type,
               CASE o_orderstatus WHEN 'O' THEN 'BEAT' WHEN 'F' THEN 'MISS' WHEN 'P' THEN 'MEET' END AS eps_surprise
        FROM orders"""),
    "metrics": ("n_sup", """
        SELECT o_orderkey AS filing_id, 'S' || (o_custkey % (SELECT n FROM n_sup)) AS ticker,
               CAST(o_orderdate AS DATE) AS filing_date,
               CAST(o_orderdate AS DATE) - CAST((o_orderkey * 7) % 91 AS INTEGER) AS report_period,
               'ttm' AS period, o_totalprice * 1000 AS market_cap,
               CASE WHEN o_orderkey % 11 <> 0 THEN c_acctbal / 10000 END AS return_on_equity,
               (o_orderkey % 100) / 100 AS net_margin, (o_custkey % 100) / 100 AS gross_margin,
               o_totalprice / 1000 AS book_value_per_share, (o_orderkey % 30) / 10 AS debt_to_equity
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "facts": ("", """
        SELECT 'S' || s_suppkey AS ticker, s_name AS name, r_name AS sector, n_name AS industry
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "news": ("n_sup", """
        SELECT doc_id, 'S' || (doc_id % (SELECT n FROM n_sup)) AS ticker, split_part(text, chr(10), 1) AS title, text, source,
               DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS date
        FROM documents"""),
    "insider": ("", """
        SELECT 'S' || l_suppkey AS ticker, CAST(o_orderdate AS DATE) AS filing_date, l_orderkey AS order_id,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS transaction_shares,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS transaction_value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY l_suppkey, l_orderkey, CAST(o_orderdate AS DATE)"""),
    "signals": ("", """
        SELECT ticker, date, model_name, k, (k - 50) / 50 AS value, k % 10 = 0 AS abstained FROM (
          SELECT 'U' || user_id AS ticker, CAST(ts AS DATE) AS date, event_type AS model_name,
                 CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                 row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY event_id DESC) AS rn
          FROM events) WHERE rn = 1"""),
    "marks": ("", """
        SELECT 'U' || user_id AS ticker, CAST(ts AS DATE) AS d, arg_max(value + 10, event_id) AS close
        FROM events GROUP BY 1, 2"""),
    "fills": ("n_sup", """
        SELECT 'F' || (o_custkey % 10) AS fund, 'S' || (o_custkey % (SELECT n FROM n_sup)) AS ticker,
               CAST(o_orderdate AS DATE) AS session, o_orderkey AS seq,
               CASE WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, o_orderkey % 100 + 1 AS quantity,
               CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,5)) * 0.001 AS DECIMAL(18,5)) AS price
        FROM orders"""),
    "answers": ("", """
        SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN substr(wrapped, 1, 30) ELSE wrapped END AS text FROM (
          SELECT event_id, event_type,
                 CASE event_id % 3 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```'
                   WHEN 1 THEN 'My view {as of now}: ' || body || ' Thanks.' ELSE body END AS wrapped
          FROM (SELECT event_id, event_type,
                  '{"signal": "' || CASE event_type WHEN 'click' THEN 'bullish' WHEN 'view' THEN 'bearish'
                     WHEN 'purchase' THEN 'neutral' ELSE 'invalid' END
                  || '", "confidence": ' || json_extract_string(props, '$.k')
                  || ', "reasoning": "e' || event_id || '"}' AS body FROM events))"""),
    "models": ("", f"SELECT * FROM {duck(MODEL_CFG)}"),
    "strategies": ("", f"SELECT * FROM {duck(STRATEGY_CFG)}"),
    "funds": ("", f"SELECT * FROM {duck(FUND_CFG)}"),
    "staffed": ("signals models strategies", """
        SELECT s.fund, s.strategy, s.mode, s.gross_target, g.date, g.ticker, g.model_name, g.value, g.abstained,
               m.weight AS vote, m.approach
        FROM signals g JOIN models m ON m.model_name = g.model_name JOIN strategies s ON s.strategy = m.strategy"""),
    "blend": ("staffed", """
        SELECT fund, strategy, mode, gross_target, date, ticker,
               coalesce(sum(vote * value) FILTER (WHERE NOT abstained) / sum(vote) FILTER (WHERE NOT abstained), 0) AS conviction,
               coalesce(sum(vote * CASE WHEN approach = 'long_short' THEN value ELSE greatest(value, 0) END) FILTER (WHERE NOT abstained)
                 / sum(vote) FILTER (WHERE NOT abstained), 0) AS short_conviction,
               count(*) AS n_signals, count(*) FILTER (WHERE abstained) AS n_abstained
        FROM staffed GROUP BY ALL"""),
    "sleeves": ("blend", """
        SELECT * EXCLUDE (longs, shorts), CASE WHEN flat_reason IS NOT NULL THEN 0
                 WHEN mode = 'dollar_neutral' THEN score / CASE WHEN score > 0 THEN longs ELSE shorts END * (gross_target / 2)
                 ELSE score / (longs + shorts) * gross_target END AS weight FROM (
          SELECT *, CASE WHEN mode = 'dollar_neutral' AND longs < 1e-9 AND shorts < 1e-9 THEN 'no_eligible_positions'
                         WHEN mode = 'dollar_neutral' AND longs < 1e-9 THEN 'missing_long_side'
                         WHEN mode = 'dollar_neutral' AND shorts < 1e-9 THEN 'missing_short_side'
                         WHEN mode <> 'dollar_neutral' AND longs + shorts < 1e-9 THEN 'no_eligible_positions' END AS flat_reason FROM (
            SELECT *, sum(greatest(score, 0)) OVER w AS longs, sum(-least(score, 0)) OVER w AS shorts FROM (
              SELECT *, greatest(conviction, 0) + CASE WHEN mode = 'long_only' THEN 0 ELSE least(short_conviction, 0) END AS score
              FROM blend) WINDOW w AS (PARTITION BY fund, strategy, date)))"""),
    "slices": ("strategies", """
        SELECT fund, strategy, weight / sum(weight) OVER (PARTITION BY fund) AS slice FROM strategies"""),
    "netted": ("sleeves slices", """
        SELECT s.fund, s.date, s.ticker, sum(c.slice * s.weight) AS netted
        FROM sleeves s JOIN slices c ON c.fund = s.fund AND c.strategy = s.strategy GROUP BY 1, 2, 3"""),
    "clamped": ("netted funds", """
        SELECT *, capped * CASE WHEN gross > max_gross_exposure THEN max_gross_exposure / gross ELSE 1 END AS final FROM (
          SELECT *, sum(abs(capped)) OVER (PARTITION BY fund, date) AS gross FROM (
            SELECT n.*, f.max_position_pct, f.max_gross_exposure,
                   sign(netted) * least(abs(netted), max_position_pct) AS capped
            FROM netted n JOIN funds f ON f.fund = n.fund))"""),
    "scaled": ("netted funds", """
        SELECT *, capped * second AS final, first_factor * second AS factor FROM (
          SELECT *, CASE WHEN gross > max_gross_exposure THEN max_gross_exposure / gross ELSE 1 END AS second FROM (
            SELECT *, netted * first_factor AS capped, sum(abs(netted * first_factor)) OVER (PARTITION BY fund, date) AS gross FROM (
              SELECT n.*, f.max_position_pct, f.max_gross_exposure,
                     least(1, max_position_pct / nullif(max(abs(netted)) OVER (PARTITION BY n.fund, n.date), 0)) AS first_factor
              FROM netted n JOIN funds f ON f.fund = n.fund)))"""),
    "risked": ("clamped scaled", """
        SELECT fund, date, ticker, netted, capped, gross, final, NULL::DOUBLE AS factor, max_position_pct, max_gross_exposure
        FROM clamped WHERE fund = 'core'
        UNION ALL SELECT fund, date, ticker, netted, capped, gross, final, factor, max_position_pct, max_gross_exposure
        FROM scaled WHERE fund = 'neutral'"""),
    "contributions": ("sleeves slices risked", """
        SELECT s.fund, s.strategy, s.date, s.ticker, s.mode, s.gross_target, c.slice,
               c.slice * s.weight * coalesce(r.factor, CASE WHEN r.netted <> 0 THEN r.final / r.netted ELSE 1 END) AS contribution
        FROM sleeves s JOIN slices c ON c.fund = s.fund AND c.strategy = s.strategy
        JOIN risked r ON r.fund = s.fund AND r.date = s.date AND r.ticker = s.ticker"""),
    # Month-end order books of the trading funds.
    "month_ends": ("market", "SELECT max(d) AS session FROM market GROUP BY year(d), month(d)"),
    "held": ("fills", """
        SELECT fund, ticker, session, lead(session) OVER w AS next_session,
               sum(moved) OVER (PARTITION BY fund, ticker ORDER BY session) AS shares
        FROM (SELECT fund, ticker, session, sum(CASE side WHEN 'buy' THEN quantity ELSE -quantity END) AS moved
              FROM fills GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY fund, ticker ORDER BY session)"""),
    "positions": ("held month_ends", """
        SELECT h.fund, m.session, h.ticker, CAST(h.shares AS BIGINT) AS shares FROM held h JOIN month_ends m
          ON m.session >= h.session AND (h.next_session IS NULL OR m.session < h.next_session) WHERE h.shares <> 0"""),
    "targets": ("month_ends", """
        SELECT 'F' || f AS fund, session, 'S' || s_suppkey AS ticker,
               ((s_suppkey * 7 + f * 13 + month(session) * 5) % 21 - 10) / 100 AS weight
        FROM supplier, range(10) r(f), month_ends WHERE (s_suppkey + f) % 3 <> 0"""),
    "books": ("targets positions bars", """
        SELECT j.fund, j.session, j.ticker, j.weight, j.shares, b.close AS mark, 1000000.0::DOUBLE AS equity FROM (
          SELECT coalesce(t.fund, p.fund) AS fund, coalesce(t.session, p.session) AS session, coalesce(t.ticker, p.ticker) AS ticker,
                 coalesce(t.weight, 0) AS weight, coalesce(p.shares, 0) AS shares
          FROM targets t FULL JOIN positions p ON p.fund = t.fund AND p.session = t.session AND p.ticker = t.ticker) j
        ASOF JOIN bars b ON b.ticker = j.ticker AND b.d <= j.session WHERE b.d >= j.session - 7"""),
    "orders_out": ("books", """
        SELECT fund, session, ticker, CASE WHEN delta > 0 THEN 'buy' ELSE 'sell' END AS side, abs(delta) AS quantity, mark AS price
        FROM (SELECT *, CAST(trunc(weight * equity / mark) AS BIGINT) - shares AS delta FROM books) WHERE delta <> 0"""),
    "nav": ("held bars market fills", """
        SELECT s.fund, s.session, CAST(100000000 + coalesce(c.cash, 0) AS DOUBLE) AS cash,
               CAST(100000000 + coalesce(c.cash, 0) + coalesce(v.value, 0) AS DOUBLE) AS nav,
               CAST(100000000 + coalesce(c.cash, 0) AS DECIMAL(28,9)) AS exact_cash,
               CAST(100000000 + coalesce(c.cash, 0) + coalesce(v.value, 0) AS DECIMAL(28,9)) AS exact_nav,
               coalesce(v.n_held, 0) AS n_held, coalesce(v.n_unpriced, 0) AS n_unpriced
        FROM (SELECT fund, d AS session FROM (SELECT DISTINCT fund FROM fills), market) s
        LEFT JOIN (SELECT fund, d, sum(flow) OVER (PARTITION BY fund ORDER BY d) AS cash FROM (
            SELECT g.fund, g.d, coalesce(sum(CASE f.side WHEN 'buy' THEN -f.quantity ELSE f.quantity END * f.price), 0) AS flow
            FROM (SELECT fund, d FROM (SELECT DISTINCT fund FROM fills), (SELECT d FROM market UNION SELECT session FROM fills)) g
            LEFT JOIN fills f ON f.fund = g.fund AND f.session = g.d GROUP BY 1, 2)) c ON c.fund = s.fund AND c.d = s.session
        LEFT JOIN (SELECT h.fund, h.d, sum(h.shares * CAST(b.close AS DECIMAL(18,9))) AS value, count(*) AS n_held,
                          count(*) FILTER (WHERE b.close IS NULL) AS n_unpriced
            FROM (SELECT h.fund, h.ticker, CAST(h.shares AS BIGINT) AS shares, m.d FROM held h JOIN market m
                    ON m.d >= h.session AND (h.next_session IS NULL OR m.d < h.next_session) WHERE h.shares <> 0) h
            ASOF LEFT JOIN bars b ON b.ticker = h.ticker AND b.d <= h.d GROUP BY 1, 2) v ON v.fund = s.fund AND v.d = s.session"""),
    # Aligned daily returns and the event study, written as range joins and regr_* aggregates.
    "returns": ("bars market", """
        SELECT ticker, d, y, x, row_number() OVER (PARTITION BY ticker ORDER BY d) - 1 AS idx FROM (
          SELECT b.ticker, b.d,
                 (b.close - lag(b.close) OVER w) / lag(b.close) OVER w AS y,
                 (m.close - lag(m.close) OVER w) / lag(m.close) OVER w AS x
          FROM bars b JOIN market m ON b.d = m.d WINDOW w AS (PARTITION BY b.ticker ORDER BY b.d))
        WHERE y IS NOT NULL"""),
    "timely": ("filings", "SELECT * FROM filings WHERE date_diff('day', report_period, filing_date) < 45"),
    "snapped": ("timely returns", """
        SELECT f.*, r.d AS event_day, r.idx FROM timely f JOIN returns r
          ON r.ticker = f.ticker AND r.d >= f.filing_date AND r.d <= f.filing_date + 4
        QUALIFY row_number() OVER (PARTITION BY f.filing_id ORDER BY r.d) = 1"""),
    "snapped_all": ("filings returns", """
        SELECT f.filing_id, r.idx FROM filings f JOIN returns r
          ON r.ticker = f.ticker AND r.d >= f.filing_date AND r.d <= f.filing_date + 4
        QUALIFY row_number() OVER (PARTITION BY f.filing_id ORDER BY r.d) = 1"""),
    "fits": ("snapped returns", """
        SELECT e.filing_id, coalesce(regr_intercept(r.y, r.x), avg(r.y)) AS alpha, coalesce(regr_slope(r.y, r.x), 0) AS beta,
               coalesce(regr_r2(r.y, r.x), 0) AS r_squared, count(*) AS n_obs
        FROM snapped e JOIN returns r ON r.ticker = e.ticker AND r.idx BETWEEN e.idx - 250 AND e.idx - 11
        WHERE e.idx >= 250 GROUP BY e.filing_id"""),
    "ars": ("snapped fits returns", """
        SELECT e.filing_id, e.ticker, e.source_type, r.idx - e.idx AS off, r.y - (f.alpha + f.beta * r.x) AS ar
        FROM snapped e JOIN fits f ON e.filing_id = f.filing_id
        JOIN returns r ON r.ticker = e.ticker AND r.idx BETWEEN e.idx AND e.idx + 20"""),
    "cars": ("ars", """
        SELECT filing_id, source_type,
               CASE WHEN max(off) >= 1 THEN sum(ar) FILTER (WHERE off <= 1) END AS car_0_1,
               CASE WHEN max(off) >= 5 THEN sum(ar) FILTER (WHERE off <= 5) END AS car_0_5,
               CASE WHEN max(off) >= 20 THEN sum(ar) END AS car_0_20
        FROM ars GROUP BY filing_id, source_type"""),
    "car_rows": ("cars", """
        SELECT filing_id, source_type, '[0,+1]' AS "window", car_0_1 AS car FROM cars WHERE car_0_1 IS NOT NULL
        UNION ALL SELECT filing_id, source_type, '[0,+5]', car_0_5 FROM cars WHERE car_0_5 IS NOT NULL
        UNION ALL SELECT filing_id, source_type, '[0,+20]', car_0_20 FROM cars WHERE car_0_20 IS NOT NULL"""),
    "car_groups": ("car_rows", """
        SELECT source_type, "window", count(*) AS n_events, avg(car) AS mean_car, stddev_samp(car) AS std_car
        FROM car_rows GROUP BY 1, 2 HAVING count(*) >= 2"""),
}


def _collect(names: list[str], done: list[str]) -> list[str]:
    for name in names:
        if name not in done:
            _collect(VIEWS[name][0].split(), done)
            done.append(name)
    return done


def with_views(names: list[str], body: str) -> str:
    """*body* preceded by the named views and whatever they read.

    A body may start with its own ``WITH [RECURSIVE]`` list, which is appended.
    """
    body = body.strip()
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n][1].strip()})" for n in _collect(names, [])]
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE "):
        recursive, body = "RECURSIVE ", body[len("WITH RECURSIVE "):]
        joiner = ",\n"
    elif body.upper().startswith("WITH "):
        body, joiner = body[len("WITH "):], ",\n"
    else:
        joiner = "\n"
    if not parts:
        return (f"WITH {recursive}" if joiner == ",\n" else "") + body
    return f"WITH {recursive}" + ",\n".join(parts) + joiner + body
