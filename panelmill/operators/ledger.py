"""Positions, cash and net asset value from a fills table.

Fills of one fund are unbounded, so running totals go through day and sequence
blocks. Daily books have one row per (fund, ticker, day) or (fund, day), which
days bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import on_dates, overlap_join
from .checks import finite, require
from .keyed import top_n_per_key
from .orders import signed_quantity
from .running import id_blocks, running

MONEY = "decimal(28,9)"  # nine decimals, and room for sums to stay exact


def _signed(fills: DataFrame) -> DataFrame:
    shares = signed_quantity(F.col("side"), F.col("quantity")).cast("bigint")
    return (
        fills.withColumn("_shares", shares)
        .withColumn("_cash", (-F.col("_shares") * F.col("price")).cast(MONEY))
    )


def positions_ledger(fills: DataFrame) -> DataFrame:
    """Signed shares of the filled ticker after each fill."""
    signed, blocks = id_blocks(_signed(fills), "seq")
    out = running(signed, ["fund", "ticker"], ["session", *blocks], ["seq"],
                  {"shares_after": ("sum", "_shares")})
    return out.drop("_shares", "_cash", *blocks)


def cash_ledger(fills: DataFrame, capital: Column) -> DataFrame:
    """Cash of the fund after each fill; it may go below zero and is shown so."""
    signed, blocks = id_blocks(_signed(fills), "seq")
    out = running(signed, ["fund"], ["session", *blocks], ["seq"], {"_run": ("sum", "_cash")})
    return out.withColumn("cash_after", capital.cast(MONEY) + F.col("_run").cast(MONEY)).drop("_shares", "_cash", *blocks, "_run")


def closing_positions(fills: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Non-zero positions after all fills up to a session."""
    kept = fills if as_of is None else fills.where(F.col("session") <= as_of)
    held = _signed(kept).groupBy("fund", "ticker").agg(F.sum("_shares").alias("shares"))
    return held.where("shares <> 0")


def tape_last(fills: DataFrame, k: int = 12) -> DataFrame:
    """The last k fills of each fund with notional, resulting side and how many came before."""
    last = top_n_per_key(
        positions_ledger(fills), ["fund"], [F.col("session").desc(), F.col("seq").desc()], k,
        salt_by=["seq"], rank_as="row",
    )
    counts = fills.groupBy("fund").agg(F.count("*").alias("_n"))
    s = F.col("shares_after")
    book = (
        F.when(s > 0, F.concat(F.lit("long "), s)).when(s < 0, F.concat(F.lit("short "), -s)).otherwise("flat")
    )
    return last.join(counts, "fund").select(
        "fund", F.col("row").cast("bigint").alias("row"), "session", "ticker", "side", "quantity",
        F.col("price").cast("double").alias("price"),
        (F.col("quantity") * F.col("price")).cast("double").alias("notional"),
        book.alias("book"), F.greatest(F.col("_n") - k, F.lit(0)).cast("bigint").alias("earlier"),
    )


def _day_moves(fills: DataFrame) -> DataFrame:
    return _signed(fills).groupBy("fund", "ticker", "session").agg(F.sum("_shares").alias("_shares"))


def daily_positions(fills: DataFrame) -> DataFrame:
    """Shares held from each fill day to the day before the next one."""
    moves = _day_moves(fills)
    w = Window.partitionBy("fund", "ticker").orderBy("session")
    return moves.select(
        "fund", "ticker", "session",
        F.sum("_shares").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint").alias("shares"),
        F.date_sub(F.lead("session").over(w), 1).alias("until"),
    )


def held_spans(fills: DataFrame, horizon: Column) -> DataFrame:
    """(fund, ticker, session, shares, until): days that a position is held unchanged, up to the horizon."""
    return (
        daily_positions(fills)
        .withColumn("until", F.coalesce("until", horizon))
        .where((F.col("shares") != 0) & (F.col("session") <= F.col("until")))
    )


def price_spans(prices: DataFrame, horizon: Column, tolerance: int | None, scale: int = 9) -> DataFrame:
    """(ticker, d, _until, mark): days that a close is good for.

    A close holds until the next one, at most *tolerance* days (0: its own day; None: without end). Closes
    that are not finite and positive are no prices.
    """
    w = Window.partitionBy("ticker").orderBy("d")
    usable = prices.where(finite(F.col("close").cast("double")) & (F.col("close") > 0))
    until = F.coalesce(F.date_sub(F.lead("d").over(w), 1), F.greatest(horizon, F.col("d")))
    if tolerance is not None:
        until = F.least(until, F.date_add("d", tolerance))
    return usable.select("ticker", "d", until.alias("_until"), F.col("close").cast(f"decimal(18,{scale})").alias("mark"))


def unpriced_stretches(
    fills: DataFrame, prices: DataFrame, sessions: DataFrame, *, tolerance: int | None = 0
) -> DataFrame:
    """Stretches in which a position is held and has no usable price: held spans minus priced spans.

    The priced parts of a held span are disjoint, so a sweep in day order finds what is between them; a span has at
    most one part a day. One row per stretch (calendar days ``first`` to ``last``) with the sessions it covers;
    stretches without a session need no price and are left out.
    """
    horizon = sessions.agg(F.max("d")).scalar()
    held = held_spans(fills, horizon)
    spans = price_spans(prices, horizon, tolerance).select("ticker", "d", "_until")
    columns = ["fund", "ticker", "session", "until", "shares"]
    parts = overlap_join(held, spans, ["ticker"], ("session", "until"), ("d", "_until")).select(*columns, "seg_start", "seg_end")
    ends = held.select(*columns, F.date_add("until", 1).alias("seg_start"), F.date_add("until", 1).alias("seg_end"))
    w = Window.partitionBy("fund", "ticker", "session").orderBy("seg_start")
    swept = parts.unionByName(ends).withColumn("_after", F.coalesce(F.date_add(F.lag("seg_end").over(w), 1), F.col("session")))
    gaps = swept.where(F.col("_after") < F.col("seg_start")).select(
        "fund", "ticker", "shares", F.col("_after").alias("first"), F.date_sub("seg_start", 1).alias("last")
    )
    # Sessions up to each calendar day: one row a day, so bounded by the years covered.
    listed = sessions.select("d").distinct()
    span = listed.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo IS NOT NULL")
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day")).join(listed.select(F.col("d").alias("day"), F.lit(1).alias("_one")), "day", "left")
    upto = days.select("day", F.sum(F.coalesce("_one", F.lit(0))).over(Window.orderBy("day")).alias("_n"))
    counted = gaps.join(F.broadcast(upto.select(F.col("day").alias("last"), F.col("_n").alias("_hi"))), "last", "left").join(
        F.broadcast(upto.select(F.date_add("day", 1).alias("first"), F.col("_n").alias("_lo"))), "first", "left"
    )
    n = F.coalesce("_hi", F.lit(0)) - F.coalesce("_lo", F.lit(0))
    return counted.withColumn("n_sessions", n.cast("bigint")).where("n_sessions > 0").select("fund", "ticker", "shares", "first", "last", "n_sessions")


def daily_nav(
    fills: DataFrame, prices: DataFrame, sessions: DataFrame, capital: Column, *, carry: bool = True,
    price_scale: int = 9, tolerance: int | None = None, require_priced: bool = False,
) -> DataFrame:
    """Cash plus marked positions of every fund on every session, as doubles.

    With *require_priced* a session on which a held name has no usable price stops the job;
    ``unpriced_stretches`` lists what is missing.
    """
    exact = exact_nav(fills, prices, sessions, capital, carry=carry, price_scale=price_scale, tolerance=tolerance)
    if require_priced:
        exact = require(exact, {"a held name has no usable price": F.col("n_unpriced") == 0})
    return exact.withColumn("cash", F.col("cash").cast("double")).withColumn("nav", F.col("nav").cast("double"))


def exact_nav(
    fills: DataFrame, prices: DataFrame, sessions: DataFrame, capital: Column, *, carry: bool = True,
    price_scale: int = 9, tolerance: int | None = None,
) -> DataFrame:
    """Cash plus marked positions of every fund on every session, as decimals.

    Positions and prices are spans of days. Value changes only where a span
    starts or ends, so NAV is a running sum of changes: the (session x fund x
    ticker) cube is never built. Amounts are decimal, hence exact in any order.
    With *carry* a price holds until the next one, at most *tolerance* days, else for its own day. Names
    held without a usable price are left out of NAV and counted in n_unpriced.
    """
    run = _nav_days(fills, prices, sessions, capital, carry=carry, price_scale=price_scale, tolerance=tolerance)
    return run.select("fund", "session", "cash", "nav", "n_held", "n_unpriced")


def _nav_days(
    fills: DataFrame, prices: DataFrame, sessions: DataFrame, capital: Column, *, carry: bool = True,
    price_scale: int = 9, tolerance: int | None = None, trades: bool = False,
) -> DataFrame:
    """``exact_nav`` with the cash, the value at the day's mark and the number of a session's own fills.

    With *trades* the shares moved on a day meet prices in the same join as the held spans, as spans of one day;
    without it ``bought`` is zero.
    """
    horizon = sessions.agg(F.max("d")).scalar()
    held = held_spans(fills, horizon)
    marks = price_spans(prices, horizon, tolerance if carry else 0, price_scale)
    asked = held.withColumn("_moved", F.lit(False))
    if trades:
        moves = _day_moves(fills).select(
            "fund", "ticker", "session", F.col("_shares").alias("shares"), F.col("session").alias("until"), F.lit(True).alias("_moved")
        )
        asked = asked.unionByName(moves)
    priced = overlap_join(asked, marks, ["ticker"], ("session", "until"), ("d", "_until"))
    zero = F.lit(0).cast(MONEY)
    none = F.lit(0).cast("bigint")

    def start_end(first: str, last: str) -> Column:
        return F.array(
            F.struct(F.col(first).alias("d"), F.lit(1).alias("s")), F.struct(F.date_add(F.col(last), 1).alias("d"), F.lit(-1).alias("s"))
        )

    value = (F.col("shares").cast("decimal(18,0)") * F.col("mark")).cast(MONEY)
    at_once = F.array(F.struct(F.col("session").alias("d"), F.lit(0).alias("s")))
    steps = F.when(F.col("_moved"), at_once).otherwise(start_end("seg_start", "seg_end")) if trades else start_end("seg_start", "seg_end")
    sign = F.col("_e.s")
    valued = priced.select("fund", F.explode(steps).alias("_e"), value.alias("_v")).select(
        "fund", "_e.d", zero.alias("cash"), F.when(sign > 0, F.col("_v")).when(sign < 0, -F.col("_v")).otherwise(zero).cast(MONEY).alias("value"),
        none.alias("held"), sign.cast("bigint").alias("priced"), F.when(sign == 0, F.col("_v")).otherwise(zero).cast(MONEY).alias("bought"), none.alias("n"),
    )
    counted = held.select("fund", F.explode(start_end("session", "until")).alias("_e")).select(
        "fund", "_e.d", zero.alias("cash"), zero.alias("value"), sign.cast("bigint").alias("held"), none.alias("priced"), zero.alias("bought"), none.alias("n"),
    )
    filled = _signed(fills).select(
        "fund", F.col("session").alias("d"), F.col("_cash").alias("cash"), zero.alias("value"), none.alias("held"), none.alias("priced"),
        zero.alias("bought"), F.lit(1).cast("bigint").alias("n"),
    )
    changes = filled.unionByName(valued).unionByName(counted)
    wanted = on_dates(fills.select("fund").distinct(), sessions, "d").select(
        "fund", "d", zero.alias("cash"), zero.alias("value"), none.alias("held"), none.alias("priced"), zero.alias("bought"), none.alias("n"),
    ).withColumn("wanted", F.lit(True))
    totals = ("cash", "value", "held", "priced")
    daily = (
        changes.withColumn("wanted", F.lit(False)).unionByName(wanted)
        .groupBy("fund", "d")
        .agg(*[F.sum(c).alias(c) for c in (*totals, "bought", "n")], F.bool_or("wanted").alias("wanted"))
    )
    upto = Window.partitionBy("fund").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    run = daily.select(
        "fund", "d", "wanted", F.col("cash").cast(MONEY).alias("_cash"), F.col("bought").cast(MONEY).alias("_bought"), F.col("n").alias("n_fills"),
        *[F.sum(c).over(upto).alias(c) for c in totals],
    )
    cash = capital.cast(MONEY) + F.col("cash").cast(MONEY)
    return run.where("wanted").select(
        "fund", F.col("d").alias("session"), cash.cast(MONEY).alias("cash"),
        (cash + F.col("value").cast(MONEY)).cast(MONEY).alias("nav"),
        F.col("held").cast("bigint").alias("n_held"), (F.col("held") - F.col("priced")).cast("bigint").alias("n_unpriced"),
        "_cash", "_bought", "n_fills",
    )


def cycle_accounting(
    fills: DataFrame, prices: DataFrame, sessions: DataFrame, capital: Column, *, price_scale: int = 9
) -> DataFrame:
    """Equity, cash, fill counts and NAV around each trading session of a fund.

    Equity before trading is NAV after it, less the traded shares at the day's
    mark, with the cash of before. A day's own fills are summed beside the changes of NAV, so prices are read once.
    """
    days = _nav_days(fills, prices, sessions, capital, price_scale=price_scale, trades=True)
    days = days.where((F.col("n_fills") > 0) & F.col("fund").isNotNull())
    before = F.col("cash") - F.col("_cash")
    equity = (F.col("nav") - F.col("_bought")).cast(MONEY) - F.col("_cash")
    return days.select(
        "fund", "session", before.cast("double").alias("cash_before"), F.col("cash").cast("double").alias("cash_after"),
        equity.cast("double").alias("equity_before"), F.col("nav").cast("double").alias("nav_after"), "n_fills",
        F.col("n_held").alias("n_positions"),
    )


def exposure_summary(positions: DataFrame, keys: tuple[str, ...] = ("fund",)) -> DataFrame:
    """Long and short value, gross and net over NAV, from (shares, mark, nav) rows."""
    value = F.col("shares") * F.col("mark")
    sums = positions.groupBy(*keys).agg(
        F.sum(F.greatest(value, F.lit(0))).alias("_l"), F.sum(F.least(value, F.lit(0))).alias("_s"),
        F.first("nav").alias("_nav"),
    )
    long, short = F.col("_l").cast("double"), F.col("_s").cast("double")
    return sums.select(
        *keys, long.alias("long_value"), short.alias("short_value"),
        ((long - short) / F.col("_nav")).alias("gross"), ((long + short) / F.col("_nav")).alias("net"),
    )


def target_vs_actual(books: DataFrame, keys: tuple[str, ...] = ("fund",)) -> DataFrame:
    """Net exposure asked for and held, in money, from (weight, shares, mark, equity) rows."""
    sums = books.groupBy(*keys).agg(
        F.sum("weight").alias("_w"), F.first("equity").alias("_e"),
        F.sum(F.col("shares") * F.col("mark")).cast("double").alias("actual_net"),
    )
    return sums.select(
        *keys, (F.col("_e") * F.col("_w")).alias("target_net"), "actual_net",
        (F.col("actual_net") - F.col("_e") * F.col("_w")).alias("difference"),
    )


def rebalanced_nav(weights: DataFrame, marks: DataFrame, periods: DataFrame) -> DataFrame:
    """NAV path (from 1.0) of a schedule of weights held between rebalances.

    *weights*: (fund, start, ticker, weight); *periods*: (start, end], unfolded to
    at most one broadcast row per calendar day; *marks*: (ticker, as_of, close)
    for every day needed. Inside a period NAV grows by one plus the weighted
    price changes; periods chain by product over the fund's days. Shares are
    fractional.
    """
    base = marks.select("ticker", F.col("as_of").alias("start"), F.col("close").alias("_base"))
    placed = weights.join(base, ["ticker", "start"])
    day_of_period = periods.select(
        "start", "end", F.explode(F.sequence(F.date_add("start", 1), F.col("end"))).alias("as_of")
    )
    days = marks.join(F.broadcast(day_of_period), "as_of")
    moved = (
        placed.join(days.select("ticker", "start", "end", "as_of", "close"), ["ticker", "start"])
        .groupBy("fund", "start", "end", "as_of")
        .agg((1 + F.sum(F.col("weight") * (F.col("close") / F.col("_base") - 1))).alias("_f"))
    )
    earlier = Window.partitionBy("fund").orderBy("as_of").rowsBetween(Window.unboundedPreceding, -1)
    chained = F.sum(F.when(F.col("as_of") == F.col("end"), F.log("_f"))).over(earlier)
    return moved.select(
        "fund", F.col("as_of").alias("session"),
        (F.exp(F.coalesce(chained, F.lit(0.0))) * F.col("_f")).alias("nav"),
    )
