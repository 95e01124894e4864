"""Blending, risk, orders and assessment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, funds, ledger, orders, portfolio, risk
from ..session import stored
from ..sources import reads
from .q_study import rounded
from .registry import query


def fine(df, *cols):
    """Weights are short decimals, so they are rounded well past any tie."""
    return rounded(df, *cols, digits=10)


def blended(t):
    return portfolio.blend_convictions(portfolio.staff(t.signals, t.models, t.strategies))


def sleeves(t):
    return portfolio.sleeve_weights(blended(t))


def slices(t):
    return portfolio.strategy_slices(t.strategies)


def netted(t):
    return portfolio.net_sleeves(sleeves(t), slices(t))


def risked(t):
    return risk.apply_limits(netted(t), t.funds, portfolio.preserves_proportions(t.strategies))


@query("join_model_weights", """
    SELECT fund, strategy, date, ticker, model_name, value, vote, approach FROM staffed""", "staffed")
def join_model_weights(t):
    return portfolio.staff(t.signals, t.models, t.strategies).select(
        "fund", "strategy", "date", "ticker", "model_name", "value", "vote", "approach"
    )


@query("blend_convictions", """
    SELECT fund, strategy, date, ticker, round(conviction, 6) AS conviction, round(short_conviction, 6) AS short_conviction,
           n_signals, n_abstained FROM blend""", "blend")
def blend_convictions(t):
    return rounded(blended(t).drop("mode", "gross_target"), "conviction", "short_conviction")


@query("sleeve_weights", """
    SELECT fund, strategy, date, ticker, round(score, 10) AS score, round(weight, 10) AS weight, flat_reason FROM sleeves
    """, "sleeves")
def sleeve_weights(t):
    return fine(
        sleeves(t).select("fund", "strategy", "date", "ticker", "score", "weight", "flat_reason"), "score", "weight"
    )


@query("net_sleeves", "SELECT fund, date, ticker, round(netted, 10) AS netted FROM netted", "netted")
def net_sleeves(t):
    return fine(netted(t), "netted")


@query("clamp_positions", """
    SELECT fund, date, ticker, round(netted, 10) AS netted, round(capped, 10) AS capped, round(gross, 10) AS gross,
           round(final, 10) AS final FROM clamped""", "clamped")
def clamp_positions(t):
    book = risk.clamp_positions(netted(t), t.funds)
    return fine(book.select("fund", "date", "ticker", "netted", "capped", "gross", "final"),
                   "netted", "capped", "gross", "final")


@query("scale_proportional", """
    SELECT fund, date, ticker, round(netted, 10) AS netted, round(factor, 10) AS factor, round(final, 10) AS final FROM scaled
    """, "scaled")
def scale_proportional(t):
    book = risk.scale_proportional(netted(t), t.funds)
    return fine(book.select("fund", "date", "ticker", "netted", "factor", "final"), "netted", "factor", "final")


@query("clamp_audit", """
    SELECT fund, date, 'max_position_pct' AS "limit", ticker, round(netted, 10) AS before, round(capped, 10) AS after
    FROM risked WHERE abs(netted) > max_position_pct
    UNION ALL SELECT fund, date, 'max_gross_exposure', NULL, round(max(gross), 10), round(max(max_gross_exposure), 10)
    FROM risked GROUP BY 1, 2 HAVING max(gross) > max(max_gross_exposure)""", "risked")
def clamp_audit(t):
    return fine(risk.clamp_audit(risked(t)), "before", "after")


def recorded_book(t):
    """The assessed book as stored records: sleeves, contributions and final weights."""
    held = stored(sleeves(t), "sleeves")
    book = stored(
        risk.apply_limits(portfolio.net_sleeves(held, slices(t)), t.funds, portfolio.preserves_proportions(t.strategies)),
        "book",
    )
    parts = portfolio.final_contributions(held, slices(t), book)
    return held, parts.select("fund", "strategy", "date", "ticker", "contribution"), book.select("fund", "date", "ticker", "final")


@query("final_contributions", """
    SELECT fund, strategy, date, ticker, round(contribution, 10) AS contribution FROM contributions""", "contributions")
def final_contributions(t):
    return fine(recorded_book(t)[1], "contribution")


# Errors written into the stored book, one or more for each rule; each is a condition and what it changes.
NO_ERRORS = {
    "lost": "false", "renamed": "false", "score_nan": "false", "score_off": "false", "target_nan": "false", "target_sign": "false",
    "slice_off": "false", "foreign": "false", "part_nan": "false", "part_off": "false", "final_nan": "false", "final_off": "false",
    "orphaned": "false", "void": "false",
}
ERRORS = {
    "lost": "fund = 'core' AND ticker LIKE '%8' OR fund = 'neutral' AND strategy = 'beta' AND day(date) % 5 = 0",
    "renamed": "fund = 'core' AND ticker LIKE '%9'",
    "score_nan": "ticker LIKE '%5' AND day(date) % 2 = 1", "score_off": "ticker LIKE '%2'",
    "target_nan": "ticker LIKE '%4' AND day(date) % 2 = 1", "target_sign": "ticker LIKE '%1'",
    "slice_off": "fund = 'core' AND strategy = 'beta'", "foreign": "fund = 'core' AND strategy = 'alpha' AND ticker LIKE '%6'",
    "part_nan": "ticker LIKE '%0' AND day(date) % 3 = 1", "part_off": "ticker LIKE '%3'",
    "final_nan": "ticker LIKE '%0' AND day(date) % 5 = 1", "final_off": "ticker LIKE '%7'",
    "orphaned": "fund = 'neutral' AND day(date) % 4 = 0", "void": "true",
}
RECORDED = """
    SELECT fund, strategy, date, CASE WHEN {renamed} THEN concat(ticker, 'x') ELSE ticker END AS ticker,
           CASE WHEN {score_nan} THEN CAST('NaN' AS DOUBLE) WHEN {score_off} THEN score + 0.25{d} ELSE score END AS score,
           CASE WHEN {target_nan} THEN CAST('NaN' AS DOUBLE) WHEN {target_sign} THEN -abs(weight) - 0.05{d} ELSE weight END AS weight,
           slice + CASE WHEN {slice_off} THEN 0.01{d} ELSE 0.0{d} END AS slice
    FROM {sleeves} WHERE NOT ({lost})
    UNION ALL SELECT fund, 'gamma', date, ticker, score, weight, slice FROM {sleeves} WHERE {foreign}"""
PARTS = """
    SELECT fund, strategy, date, ticker, CASE WHEN {part_nan} THEN CAST('NaN' AS DOUBLE) WHEN {part_off} THEN contribution + 0.5{d} ELSE contribution END AS contribution
    FROM {parts}"""
FINALS = """
    SELECT fund, date, ticker, CASE WHEN {final_nan} THEN CAST('NaN' AS DOUBLE) WHEN {final_off} THEN final + 0.07{d} ELSE final END AS final FROM {finals}
    UNION ALL SELECT 'orphan', date, ticker, final FROM {finals} WHERE {orphaned}"""
MANDATE = """
    SELECT fund, strategy, weight, mode, gross_target FROM {strategies}
    UNION ALL SELECT 'void', 'alpha', 0.0{d}, 'long_only', 1.0{d} WHERE {void}"""


def _validate_sql(errors: dict[str, str]) -> str:
    given = errors | {"d": "::DOUBLE", "sleeves": "sliced", "parts": "contributions", "finals": "risked", "strategies": "strategies"}
    weights = [("target", "gross_target"), ("contribution", "gross_target * share")]
    by_name = " UNION ALL ".join(f"""
      SELECT '{w} of a strategy outside the mandate' AS rule, fund, strategy, date, ticker, {w} AS observed, NULL::DOUBLE AS bound FROM names WHERE {w} IS NOT NULL AND mode IS NULL
      UNION ALL SELECT '{w} not finite', fund, strategy, date, ticker, {w}, NULL FROM names WHERE NOT isfinite({w})
      UNION ALL SELECT 'long-only {w} negative', fund, strategy, date, ticker, {w}, 0.0 FROM names WHERE isfinite({w}) AND mode = 'long_only' AND {w} < -1e-9
      UNION ALL SELECT 'negative {w} without short evidence', fund, strategy, date, ticker, {w}, 0.0 FROM names WHERE isfinite({w}) AND {w} < -1e-9 AND coalesce(proof, 0) >= 0
      UNION ALL SELECT 'flat strategy with {w}', fund, strategy, date, ticker, {w}, 0.0 FROM names WHERE isfinite({w}) AND flat_reason IS NOT NULL AND abs({w}) > 1e-9
      UNION ALL SELECT '{w} gross not finite', fund, strategy, date, NULL, {w}_gross, {limit} FROM sums WHERE NOT isfinite({w}_gross)
      UNION ALL SELECT '{w} exceeds gross target', fund, strategy, date, NULL, {w}_gross, {limit} FROM sums WHERE isfinite({w}_gross) AND {w}_gross > {limit} + 1e-9
      UNION ALL SELECT '{w} not dollar-neutral', fund, strategy, date, NULL, {w}_net, 0.0 FROM sums WHERE isfinite({w}_gross) AND mode = 'dollar_neutral' AND abs({w}_net) > 1e-9
      """ for w, limit in weights)
    return f"""
    WITH sliced AS (SELECT s.*, c.slice FROM sleeves s JOIN slices c ON c.fund = s.fund AND c.strategy = s.strategy),
    recorded AS ({RECORDED.format(**given)}), parts AS ({PARTS.format(**given)}), finals AS ({FINALS.format(**given)}), terms AS ({MANDATE.format(**given)}),
    mandate AS (SELECT *, CASE WHEN sum(weight) OVER f > 0 THEN weight / sum(weight) OVER f END AS share FROM terms WINDOW f AS (PARTITION BY fund)),
    names AS (
      SELECT k.*, m.mode, m.gross_target, m.share FROM (
        SELECT fund, strategy, date, ticker, r.score, r.weight AS target, r.slice, e.score AS proof, e.flat_reason, c.contribution
        FROM recorded r FULL JOIN sleeves e USING (fund, strategy, date, ticker) FULL JOIN parts c USING (fund, strategy, date, ticker)) k
      LEFT JOIN mandate m ON m.fund = k.fund AND m.strategy = k.strategy),
    sums AS (
      SELECT fund, strategy, date, mode, gross_target, share, count(score) AS n_score, count(proof) AS n_proof, max(slice) AS slice, sum(target) AS target_net,
             sum(abs(target)) AS target_gross, sum(contribution) AS contribution_net, sum(abs(contribution)) AS contribution_gross
      FROM names GROUP BY ALL),
    book AS (
      SELECT b.*, l.max_position_pct, l.max_gross_exposure FROM (
        SELECT fund, date, ticker, coalesce(f.final, 0) AS final, coalesce(p.combined, 0) AS combined
        FROM finals f FULL JOIN (SELECT fund, date, ticker, sum(contribution) AS combined FROM parts GROUP BY 1, 2, 3) p USING (fund, date, ticker)) b
      LEFT JOIN funds l ON l.fund = b.fund),
    gross AS (SELECT fund, date, sum(abs(final)) AS gross, max(max_gross_exposure) AS bound FROM book GROUP BY 1, 2)
    SELECT rule, fund, strategy, date, ticker, round(observed, 10) AS observed, round(bound, 10) AS bound FROM ({by_name}
      UNION ALL SELECT 'score without evidence', fund, strategy, date, ticker, score, NULL FROM names WHERE score IS NOT NULL AND proof IS NULL
      UNION ALL SELECT 'evidence without score', fund, strategy, date, ticker, NULL, proof FROM names WHERE score IS NULL AND proof IS NOT NULL
      UNION ALL SELECT 'score not finite', fund, strategy, date, ticker, score, proof FROM names WHERE NOT isfinite(score)
      UNION ALL SELECT 'score does not match evidence', fund, strategy, date, ticker, score, proof FROM names WHERE isfinite(score) AND abs(score - proof) > 1e-9
      UNION ALL SELECT 'strategy outside the mandate', fund, strategy, date, NULL, NULL, NULL FROM sums WHERE n_score > 0 AND mode IS NULL
      UNION ALL SELECT 'strategy has no record', fund, strategy, date, NULL, NULL, NULL FROM sums WHERE n_proof > 0 AND n_score = 0
      UNION ALL SELECT 'slice does not match the mandate', fund, strategy, date, NULL, slice, share FROM sums WHERE n_score > 0 AND mode IS NOT NULL AND abs(slice - share) > 1e-9
      UNION ALL SELECT 'final weight or contribution not finite', fund, NULL, date, ticker, final, combined FROM book WHERE NOT (isfinite(final) AND isfinite(combined))
      UNION ALL SELECT 'contributions do not sum to final', fund, NULL, date, ticker, final, combined FROM book WHERE isfinite(final) AND isfinite(combined) AND abs(final - combined) > 1e-9
      UNION ALL SELECT 'final exceeds position cap', fund, NULL, date, ticker, final, max_position_pct FROM book WHERE isfinite(final) AND abs(final) > max_position_pct + 1e-9
      UNION ALL SELECT 'fund has no limits', fund, NULL, date, NULL, gross, NULL FROM gross WHERE bound IS NULL
      UNION ALL SELECT 'final gross not finite', fund, NULL, date, NULL, gross, bound FROM gross WHERE NOT isfinite(gross)
      UNION ALL SELECT 'final exceeds gross cap', fund, NULL, date, NULL, gross, bound FROM gross WHERE isfinite(gross) AND gross > bound + 1e-9
      UNION ALL SELECT 'allocations need a finite, positive total', fund, NULL, NULL, NULL, sum(weight), 0.0 FROM mandate WHERE share IS NULL GROUP BY fund)"""


BOOK_VIEWS = "sleeves slices contributions risked strategies funds"


def _validated(t, errors):
    """The stored book with *errors* written into it, against evidence worked out again from the signals."""
    held, parts, finals = recorded_book(t)
    given = errors | {"d": "D"}
    spark = t.spark
    recorded = spark.sql(RECORDED.format(**given, sleeves="{sleeves}"), sleeves=held.join(slices(t), ["fund", "strategy"]))
    parts = spark.sql(PARTS.format(**given, parts="{parts}"), parts=parts)
    finals = spark.sql(FINALS.format(**given, finals="{finals}"), finals=finals)
    mandate = spark.sql(MANDATE.format(**given, strategies="{strategies}"), strategies=t.strategies)
    return portfolio.validate_book(recorded, sleeves(t), parts, finals, mandate, t.funds)


@query("validate_book", _validate_sql(ERRORS), BOOK_VIEWS)
def validate_book(t):
    """Known errors are written into the stored book, so that every rule has something to find."""
    return fine(_validated(t, ERRORS), "observed", "bound")


@query("validate_book_clean", _validate_sql(NO_ERRORS), BOOK_VIEWS)
def validate_book_clean(t):
    """The book as computed breaks no rule."""
    return fine(_validated(t, NO_ERRORS), "observed", "bound")


@query("union_books", """
    SELECT coalesce(c.fund, f.fund) AS fund, coalesce(c.date, f.date) AS date, coalesce(c.ticker, f.ticker) AS ticker,
           round(coalesce(c.combined, 0), 10) AS combined, round(coalesce(f.final, 0), 10) AS final
    FROM (SELECT fund, date, ticker, sum(contribution) AS combined FROM contributions WHERE ticker NOT LIKE '%3' GROUP BY 1, 2, 3) c
    FULL JOIN (SELECT fund, date, ticker, final FROM risked WHERE ticker NOT LIKE '%7') f
      ON f.fund = c.fund AND f.date = c.date AND f.ticker = c.ticker""", "contributions risked")
def union_books(t):
    _, parts, finals = recorded_book(t)
    parts = parts.where(~F.col("ticker").endswith("3"))
    finals = finals.where(~F.col("ticker").endswith("7"))
    return fine(portfolio.union_books(parts, finals), "combined", "final")


# Assessed as of this instant: signals of its New York day and later are not complete.
NOW, COMPLETE = "2024-01-20 12:00:00", "DATE '2024-01-20'"
MARKED_SQL = f"""
    grid AS (SELECT DISTINCT ticker, date FROM signals),
    marked AS (SELECT g.ticker, g.date, m.close AS mark FROM grid g ASOF JOIN marks m ON m.ticker = g.ticker AND m.d <= g.date
               WHERE m.d >= g.date - 7),
    held AS (SELECT r.*, m.mark FROM risked r JOIN marked m ON m.ticker = r.ticker AND m.date = r.date WHERE r.date < {COMPLETE})"""


def assessment(t, observation=None, now=None):
    now = F.to_timestamp(F.lit(NOW)) if now is None else now
    voted = reads.completed_days(t.signals, now, day="date")
    return portfolio.assess(voted, t.marks, t.models, t.strategies, t.funds, now=now, observation=observation)


@query("assess_panel", """
    WITH grid AS (SELECT DISTINCT ticker, date FROM signals),
    marked AS (SELECT g.ticker, g.date, m.close AS mark FROM grid g ASOF JOIN marks m ON m.ticker = g.ticker AND m.d <= g.date
               WHERE m.d >= g.date - 7)
    SELECT r.fund, r.date, r.ticker, m.mark, round(r.netted, 10) AS netted, round(r.final, 10) AS final
    FROM risked r JOIN marked m ON m.ticker = r.ticker AND m.date = r.date""", "signals marks risked")
def assess_panel(t):
    """Every (fund, date, ticker) of the panel, assessed at noon after its last day, so that all of its days are complete."""
    last = t.table("events").agg(F.max(F.col("ts").cast("date"))).scalar()
    book = assessment(t, now=F.date_add(last, 1).cast("timestamp") + F.expr("INTERVAL 12 HOURS")).book
    return fine(book.select("fund", "date", "ticker", "mark", "netted", "final"), "netted", "final")


@query("assess_report", f"""
    WITH {MARKED_SQL},
    missed AS (SELECT date, count(*) AS n FROM grid WHERE (ticker, date) NOT IN (SELECT (ticker, date) FROM marked) GROUP BY 1)
    SELECT h.fund, h.date, count(*) AS n_names, round(sum(abs(netted)), 10) AS gross_before, round(sum(abs(final)), 10) AS gross_final,
           round(sum(final), 10) AS net_final, count(*) FILTER (WHERE abs(netted) > max_position_pct) AS n_position_clamps,
           CAST(max(gross) > max(max_gross_exposure) AS BIGINT) AS n_gross_clamps, 0::BIGINT AS n_violations, coalesce(max(m.n), 0) AS n_skipped
    FROM held h LEFT JOIN missed m ON m.date = h.date GROUP BY 1, 2""", "signals marks risked")
def assess_report(t):
    """Every (fund, date) of the panel: exposure, limits that fired, rules broken, names left out."""
    return fine(assessment(t).report(), "gross_before", "gross_final", "net_final")


@query("strategy_mode_derivation", """
    SELECT strategy, CASE WHEN bool_or(approach = 'long_short') THEN 'long_short' ELSE 'long_only' END AS mode,
           CASE WHEN bool_and(model_name IN ('click', 'view', 'purchase')) THEN 'discretionary' ELSE 'systematic' END AS kind
    FROM staffed GROUP BY 1""", "staffed")
def strategy_mode_derivation(t):
    staffed = portfolio.staff(t.signals, t.models, t.strategies)
    return portfolio.strategy_modes(staffed, F.col("model_name").isin("click", "view", "purchase"))


@query("distinct_models", """
    SELECT 'U' || user_id AS fund, event_type AS model_name, min(event_id) AS pos FROM events GROUP BY 1, 2""")
def distinct_models(t):
    staffing = t.table("events").select(
        F.concat(F.lit("U"), F.col("user_id")).alias("fund"), F.col("event_type").alias("model_name"),
        F.col("event_id").alias("pos"),
    )
    return portfolio.distinct_models(staffing)


@query("abstention_counts", """
    SELECT fund, strategy, date, count(*) AS n_signals, count(*) FILTER (WHERE abstained) AS n_abstained FROM staffed GROUP BY 1, 2, 3
    """, "staffed")
def abstention_counts(t):
    return portfolio.abstention_counts(portfolio.staff(t.signals, t.models, t.strategies))


@query("input_violations", """
    SELECT 'signal must be finite and within [-1, 1]' AS rule, model_name || ':' || ticker || ':' || date AS subject
    FROM signals WHERE value + 0.3 > 1
    UNION ALL SELECT DISTINCT 'model has no vote weight', model_name FROM signals
      WHERE model_name NOT IN (SELECT model_name FROM models WHERE model_name <> 'view')
    UNION ALL SELECT 'vote weight must be finite and positive', strategy || ':' || model_name FROM models WHERE weight - 1 <= 0 AND model_name <> 'view'
    """, "signals models")
def input_violations(t):
    models = t.models.where("model_name <> 'view'").withColumn("weight", F.col("weight") - 1)
    return portfolio.input_violations(t.signals.withColumn("value", F.col("value") + 0.3), models, t.strategies)


# Month-end order books of the trading funds.


def month_ends(t):
    return t.market.groupBy(F.trunc("d", "MM").alias("_m")).agg(F.max("d").alias("session")).select("session")


def positions(t):
    horizon = t.market.agg(F.max("d")).scalar()
    held = ledger.daily_positions(t.fills).where("shares <> 0").withColumnRenamed("session", "_from")
    spans = held.withColumn("until", F.coalesce("until", horizon))
    return asof.spans_on_dates(spans, month_ends(t), "session", "_from", "until", "session").select(
        "fund", "session", "ticker", "shares"
    )


#: Tasks that unfold suppliers to target weights.
UNFOLD_TASKS = 64


def targets(t):
    # A supplier unfolds into hundreds of rows, and a scan sizes tasks by the file's bytes.
    cells = asof.on_dates(t.table("supplier").select("s_suppkey").repartition(UNFOLD_TASKS, "s_suppkey"), month_ends(t), "session")
    asked = cells.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(9))))
    code = F.col("s_suppkey") * 7 + F.col("_f") * 13 + F.month("session") * 5
    return asked.where((F.col("s_suppkey") + F.col("_f")) % 3 != 0).select(
        F.concat(F.lit("F"), F.col("_f")).alias("fund"), "session",
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), ((code % 21 - 10) / 100).alias("weight"),
    )


def books(t):
    joined = orders.join_targets_positions(targets(t), positions(t))
    marks = asof.carry_forward(t.closes, ["ticker"], "d", tolerance=7, as_of="session", dates=month_ends(t).select("session"))
    return joined.join(marks.select("ticker", "session", F.col("close").alias("mark")), ["ticker", "session"]).withColumn(
        "equity", F.lit(1_000_000.0)
    )


@query("join_targets_positions", """
    SELECT coalesce(t.fund, p.fund) AS fund, coalesce(t.session, p.session) AS session, coalesce(t.ticker, p.ticker) AS ticker,
           coalesce(t.weight, 0) AS weight, coalesce(p.shares, 0) AS shares
    FROM targets t FULL JOIN positions p ON p.fund = t.fund AND p.session = t.session AND p.ticker = t.ticker""",
    "targets positions")
def join_targets_positions(t):
    return orders.join_targets_positions(targets(t), positions(t))


@query("delta_orders", "SELECT fund, session, ticker, side, quantity, price FROM orders_out", "orders_out")
def delta_orders(t):
    return orders.delta_orders(books(t))


@query("order_sequence", """
    SELECT fund, session, ticker, side, row_number() OVER (PARTITION BY fund, session ORDER BY side = 'buy', ticker) AS seq
    FROM orders_out""", "orders_out")
def order_sequence(t):
    sent = stored(orders.delta_orders(books(t)), "orders")
    return orders.order_sequence(sent).select("fund", "session", "ticker", "side", "seq")


@query("projected_exposure_check", """
    WITH after AS (SELECT b.fund, b.session, b.ticker, (b.shares + coalesce(CASE o.side WHEN 'buy' THEN o.quantity ELSE -o.quantity END, 0)) * mark / equity AS w
      FROM books b LEFT JOIN orders_out o ON o.fund = b.fund AND o.session = b.session AND o.ticker = b.ticker)
    SELECT fund, session, 'max_position_pct' AS "limit", ticker, round(w, 6) AS observed, 0.0985::DOUBLE AS bound FROM after WHERE abs(w) > 0.0985 + 1e-9
    UNION ALL SELECT fund, session, 'max_gross_exposure', NULL, round(sum(abs(w)), 6), 3.33::DOUBLE FROM after GROUP BY 1, 2
      HAVING sum(abs(w)) > 3.33 + 1e-9""", "books orders_out")
def projected_exposure_check(t):
    book = stored(books(t), "books")
    limits = t.fills.select("fund").distinct().select(
        "fund", F.lit(0.0985).alias("max_position_pct"), F.lit(3.33).alias("max_gross_exposure")
    )
    return rounded(orders.projected_violations(book, orders.delta_orders(book), limits), "observed")


def exact_books(t):
    """Order books with decimal amounts, whose sums do not depend on row order."""
    return books(t).select(
        "fund", "session", "ticker", F.col("weight").cast("decimal(18,9)").alias("weight"),
        F.col("shares").cast("decimal(18,0)").alias("shares"), F.col("mark").cast("decimal(18,9)").alias("mark"), "equity",
    )


EXACT_SQL = """
    exact AS (SELECT fund, session, CAST(weight AS DECIMAL(18,9)) AS weight,
                     CAST(shares AS DECIMAL(18,0)) * CAST(mark AS DECIMAL(18,9)) AS held FROM books)"""


@query("exposure_summary", f"""
    WITH {EXACT_SQL},
    s AS (SELECT fund, session, CAST(sum(greatest(held, 0)) AS DOUBLE) AS long_value, CAST(sum(least(held, 0)) AS DOUBLE) AS short_value
          FROM exact GROUP BY 1, 2)
    SELECT *, (long_value - short_value) / 1000000.0::DOUBLE AS gross, (long_value + short_value) / 1000000.0::DOUBLE AS net FROM s""", "books")
def exposure_summary(t):
    return ledger.exposure_summary(exact_books(t).withColumn("nav", F.col("equity")), ("fund", "session"))


@query("target_vs_actual_net", f"""
    WITH {EXACT_SQL},
    s AS (SELECT fund, session, 1000000.0::DOUBLE * CAST(sum(weight) AS DOUBLE) AS target_net, CAST(sum(held) AS DOUBLE) AS actual_net
          FROM exact GROUP BY 1, 2)
    SELECT *, actual_net - target_net AS difference FROM s""", "books")
def target_vs_actual_net(t):
    return ledger.target_vs_actual(exact_books(t), ("fund", "session"))


@query("schedule_table", """
    SELECT d, close, d IN (SELECT max(d) FROM market GROUP BY isoyear(d), weekofyear(d)) AS rebalances,
           CASE WHEN d IN (SELECT max(d) FROM market GROUP BY isoyear(d), weekofyear(d)) THEN lead(d) OVER (ORDER BY d) END AS execution_date
    FROM market""", "market")
def schedule_table(t):
    return funds.schedule_table(t.market.select("d", "close"), "weekly")


@query("assessment_dates", """
    WITH w AS (SELECT d, d IN (SELECT max(d) FROM market GROUP BY isoyear(d), weekofyear(d)) AS r, lead(d) OVER (ORDER BY d) AS n FROM market)
    SELECT d FROM w WHERE r UNION SELECT n - 1 FROM w WHERE r AND n IS NOT NULL""", "market")
def assessment_dates(t):
    return funds.assessment_dates(funds.schedule_table(t.market.select("d", "close"), "weekly"))


def signal_schedule(t):
    sessions = t.marks.groupBy("d").agg(F.max("close").alias("close"))
    return funds.schedule_table(sessions, "weekly")


SIGNAL_SCHEDULE_SQL = """
    sessions AS (SELECT DISTINCT d FROM marks),
    plan AS (SELECT d, d IN (SELECT max(d) FROM sessions GROUP BY isoyear(d), weekofyear(d)) AS rebalances,
                    lead(d) OVER (ORDER BY d) AS next_session FROM sessions)"""


@query("pending_proposals", f"""
    WITH {SIGNAL_SCHEDULE_SQL} SELECT DISTINCT r.fund, r.date, 'no later session inside the window' AS reason
    FROM risked r JOIN plan p ON p.d = r.date AND p.rebalances AND p.next_session IS NULL""", "marks risked")
def pending_proposals(t):
    return funds.pending_proposals(signal_schedule(t), risked(t)).select("fund", "date", "reason")


@query("refresh_assessment", f"""
    WITH {SIGNAL_SCHEDULE_SQL} SELECT r.fund, r.date, p.next_session AS execution_date, r.ticker, round(r.final, 10) AS final
    FROM plan p JOIN risked r ON r.date = p.next_session - 1 WHERE p.rebalances""", "marks risked")
def refresh_assessment(t):
    planned = signal_schedule(t).where("execution_date IS NOT NULL").select("execution_date")
    due = asof.on_dates(t.funds.select("fund"), planned, "execution_date")
    out = orders.execution_views(due, risked(t).select("fund", "date", "ticker", "final"))
    return fine(out.select("fund", "date", "execution_date", "ticker", "final"), "final")
