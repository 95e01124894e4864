"""Single-signal trade study: entries, fixed-hold trades, curve and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import round_exact
from .checks import finite
from .running import dense_index, running
from .series import exit_at

CAPITAL, PER_TRADE, HOLD = 100_000.0, 10_000.0, 5
MONEY = "decimal(18,2)"


def non_overlapping_entries(
    panel: DataFrame, *, hold: int = HOLD, threshold: float = 0.0, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Entries of each ticker: act on a signal, stay busy *hold* sessions, re-arm on a flat day.

    *panel* has one (ticker, d, value) row per trading day. A new entry always
    follows a flat day at or after the previous exit, so it is the onset of a
    run of active days at least hold + 1 sessions after the previous entry; only
    onsets whose exit exists in the data are candidates. The greedy choice folds
    over a ticker's candidate list, which its trading days bound.
    """
    w = Window.partitionBy("ticker").orderBy("d")
    everything = panel if start is None else panel.where(F.col("d") >= F.lit(start).cast("date"))
    days = everything.select(
        "ticker", "d", "value",
        (finite(F.col("value")) & (F.abs("value") > threshold)).alias("_on"),
        (F.row_number().over(w) - 1).alias("_i"),
        F.lead("d", hold).over(w).alias("_exit"),
    )
    onsets = days.withColumn("_was", F.coalesce(F.lag("_on").over(w), F.lit(False))).where(
        F.col("_on") & ~F.col("_was") & F.col("_exit").isNotNull()
    )
    if end is not None:
        onsets = onsets.where(F.col("d") <= F.lit(end).cast("date"))
    listed = onsets.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("_i", "d", "value"))).alias("_c"))
    return (
        listed.select("ticker", F.explode(_greedy(F.col("_c"), F.lit(hold).cast("bigint"))).alias("_p"))
        .select("ticker", F.col("_p.d").alias("entry_date"), F.col("_p.value").alias("value"))
    )


def _greedy(candidates: Column, hold: Column) -> Column:
    """Candidates in order, each at least hold + 1 sessions after the one picked before it."""

    def take(state: Column, c: Column) -> Column:
        free = c["_i"] > state["last"] + hold
        taken = F.struct(c["_i"].cast("bigint").alias("last"), F.concat(state["picks"], F.array(c)).alias("picks"))
        return F.when(free, taken).otherwise(state)

    first = F.struct((-hold - 1).alias("last"), F.slice(candidates, 1, 0).alias("picks"))
    return F.aggregate(candidates, first, take, lambda s: s["picks"])


def fixed_hold_trades(
    entries: DataFrame, bars: DataFrame, *, hold: int = HOLD, per_trade: float = PER_TRADE
) -> DataFrame:
    """Fill each entry at its close and the close *hold* sessions on, with equal money.

    Profit and return come from unrounded shares and prices. Entries without an
    exit or a positive price are not filled.
    """
    priced = exit_at(bars, hold).select(
        "ticker", F.col("d").alias("entry_date"), F.col("close").alias("entry_price"), "exit_date", "exit_price"
    )
    joined = entries.join(priced, ["ticker", "entry_date"]).withColumn("holding_days", F.lit(hold).cast("bigint"))
    return _filled(joined, per_trade)


def _filled(joined: DataFrame, per_trade: float) -> DataFrame:
    """Shares, profit and return of entries beside their prices."""
    more = [c for c in ("threshold",) if c in joined.columns]
    joined = joined.where("exit_date IS NOT NULL AND entry_price > 0")
    long = F.col("value") > 0
    gain = F.when(long, F.col("exit_price") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("exit_price"))
    shares = F.lit(per_trade) / F.col("entry_price")
    return joined.select(
        "ticker", F.when(long, "long").otherwise("short").alias("direction"),
        "entry_date", "exit_date", "entry_price", "exit_price",
        F.round(shares, 4).alias("shares"),
        F.round(shares * gain, 2).alias("pnl"),
        F.round(gain / F.col("entry_price"), 6).alias("return_pct"),
        "holding_days", *more,
    )


def equity_curve(trades: DataFrame, keys: Sequence[str], capital: float = CAPITAL) -> DataFrame:
    """Equity after each trade in entry order, with its running peak and drawdown.

    Totals run over entry-date and ticker-prefix blocks, so a strategy's trades
    never share one task. The peak starts at the capital.
    """
    money = trades.withColumn("_pnl", F.col("pnl").cast(MONEY)).withColumn("_head", F.substring("ticker", 1, 3))
    blocks = ["entry_date", "_head"]
    summed = running(money, keys, blocks, ["ticker"], {"_run": ("sum", "_pnl")})
    curve = summed.withColumn("equity", (F.lit(capital) + F.col("_run").cast("double")))
    peaked = running(curve, keys, blocks, ["ticker"], {"_peak": ("max", "equity")})
    peak = F.greatest(F.col("_peak"), F.lit(capital))
    return (
        peaked.withColumn("equity", F.round("equity", 2))
        .withColumn("peak", F.round(peak, 2))
        .withColumn("drawdown", (F.col("peak") - F.col("equity")) / F.col("peak"))
        .drop("_pnl", "_head", "_run", "_peak")
    )


def with_start(curve: DataFrame, keys: Sequence[str], capital: float = CAPITAL) -> DataFrame:
    """The curve of each key with its opening point, the capital before any trade."""
    opening = curve.select(*keys).distinct()
    for name, kind in curve.dtypes:
        if name in keys:
            continue
        value = F.lit(capital) if name in ("equity", "peak") else F.lit(0.0 if name == "drawdown" else None)
        opening = opening.withColumn(name, value.cast(kind))
    return curve.unionByName(opening)


def number_trades(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trades numbered from 1 by entry date, then ticker."""
    headed = trades.withColumn("_head", F.substring("ticker", 1, 3))
    return dense_index(headed, keys, ["entry_date", "_head"], ["ticker"], name="seq", start=1).drop("_head")


def _ratios(
    n: Column, total: Column, mean: Column, std: Column, first: Column, last: Column
) -> tuple[Column, Column]:
    """Annualised return and Sharpe ratio of a trade list."""
    years = F.greatest(F.datediff(last, first) / 365.25, F.lit(0.01))
    annual = F.pow(1 + total, 1 / years) - 1
    spread = F.when(n > 1, std).otherwise(1.0)
    sharpe = F.when(spread > 0, mean / spread * F.sqrt(n / years)).otherwise(0.0)
    return annual, sharpe


def trade_metrics(trades: DataFrame, keys: Sequence[str], capital: float = CAPITAL) -> DataFrame:
    """Summary of each key's trades.

    The last exit is the one of the last trade by entry. Sharpe scales by the
    root of trades per year.
    """
    curve = equity_curve(trades, keys, capital)
    order = F.struct("entry_date", "ticker")
    r = F.col("return_pct")
    sums = curve.groupBy(*keys).agg(
        F.count("*").alias("n_trades"),
        F.count_if(F.col("direction") == "long").alias("n_long"),
        F.count_if(F.col("direction") == "short").alias("n_short"),
        F.max_by("equity", order).alias("_end"),
        F.min("entry_date").alias("_first"), F.max_by("exit_date", order).alias("_last"),
        (F.sum(r.cast("decimal(18,6)")).cast("double") / F.count("*")).alias("_mean"), F.stddev_samp(r).alias("_std"),
        F.max("drawdown").alias("_dd"), F.count_if(r > 0).alias("_wins"),
        F.avg("holding_days").alias("_hold"),
    )
    n = F.col("n_trades")
    total = (F.col("_end") - capital) / capital
    annual, sharpe = _ratios(n, total, F.col("_mean"), F.col("_std"), F.col("_first"), F.col("_last"))
    return sums.select(
        *keys,
        round_exact(total, 6).alias("total_return_pct"), F.round(annual, 6).alias("annualized_return_pct"),
        F.round(sharpe, 4).alias("sharpe_ratio"),
        F.round(F.greatest("_dd", F.lit(0.0)), 6).alias("max_drawdown_pct"),
        round_exact(F.col("_wins") / n, 4).alias("win_rate"), "n_trades", "n_long", "n_short",
        round_exact(F.col("_mean"), 6).alias("avg_return_pct"), F.round("_hold", 1).alias("avg_holding_days"),
    )


def expanding_trade_metrics(trades: DataFrame, keys: Sequence[str], capital: float = CAPITAL) -> DataFrame:
    """The running view: metrics over the trades so far, after every trade.

    Mean and deviation come from running decimal sums of returns and their
    squares, which are exact.
    """
    curve = equity_curve(trades, keys, capital).withColumn("_head", F.substring("ticker", 1, 3))
    r = F.col("return_pct")
    fed = (
        curve.withColumn("_r", r.cast("decimal(18,6)"))
        .withColumn("_rr", (r * r).cast("decimal(28,12)"))
        .withColumn("_win", F.when(r > 0, 1).otherwise(0).cast("bigint"))
        .withColumn("_one", F.lit(1).cast("bigint"))
    )
    run = running(
        fed, keys, ["entry_date", "_head"], ["ticker"],
        {"n_trades": ("sum", "_one"), "_sr": ("sum", "_r"), "_srr": ("sum", "_rr"), "_wins": ("sum", "_win"),
         "max_dd": ("max", "drawdown"), "first_entry": ("min", "entry_date")},
    )
    n = F.col("n_trades")
    sr, srr = F.col("_sr").cast("double"), F.col("_srr").cast("double")
    mean = sr / n
    variance = F.when(n > 1, F.greatest((srr - sr * sr / n) / (n - 1), F.lit(0.0)))
    total = (F.col("equity") - capital) / capital
    annual, sharpe = _ratios(n, total, mean, F.sqrt(variance), F.col("first_entry"), F.col("exit_date"))
    return run.select(
        *keys, "ticker", "entry_date", "n_trades", "equity",
        round_exact(total, 6).alias("total_return_pct"), F.round(annual, 6).alias("annualized_return_pct"),
        F.round(sharpe, 4).alias("sharpe_ratio"),
        F.round(F.greatest("max_dd", F.lit(0.0)), 6).alias("max_drawdown_pct"),
        round_exact(F.col("_wins") / n, 4).alias("win_rate"), round_exact(mean, 6).alias("avg_return_pct"),
    )


def trade_study(
    panel: DataFrame, bars: DataFrame, *, holds: Sequence[int] = (HOLD,), thresholds: Sequence[float] = (0.0,),
    per_trade: float = PER_TRADE, start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Trades of every (hold, threshold) setting of a sweep over one signal panel.

    One plan for all settings: the panel unfolds to the thresholds, a ticker's list of onsets
    to the holds, and each bar carries its exits at all holds, so panel and bars are read once.
    """
    holds = list(dict.fromkeys(holds))
    w = Window.partitionBy("ticker").orderBy("d")
    days = panel if start is None else panel.where(F.col("d") >= F.lit(start).cast("date"))
    days = days.select(
        "ticker", "d", "value", (F.row_number().over(w) - 1).alias("_i"),
        F.array(*[F.lead("d", h).over(w).isNotNull() for h in holds]).alias("_exits"),
    ).withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in dict.fromkeys(thresholds)])))
    days = days.withColumn("_on", finite(F.col("value")) & (F.abs("value") > F.col("threshold")))
    each = Window.partitionBy("ticker", "threshold").orderBy("d")
    onsets = days.withColumn("_was", F.coalesce(F.lag("_on").over(each), F.lit(False))).where("_on AND NOT _was")
    if end is not None:
        onsets = onsets.where(F.col("d") <= F.lit(end).cast("date"))
    listed = onsets.groupBy("ticker", "threshold").agg(
        F.array_sort(F.collect_list(F.struct("_i", "d", "value", "_exits"))).alias("_c")
    )
    listed = listed.select("*", F.posexplode(F.array(*[F.lit(h).cast("bigint") for h in holds])).alias("_h", "holding_days"))
    open_ = F.filter("_c", lambda c: F.element_at(c["_exits"], F.col("_h") + 1))
    picks = _greedy(open_, F.col("holding_days"))
    entries = listed.select("ticker", "threshold", "_h", "holding_days", F.explode(picks).alias("_p")).select(
        "ticker", "threshold", "_h", "holding_days", F.col("_p.d").alias("entry_date"), F.col("_p.value").alias("value")
    )
    priced = bars.select(
        "ticker", F.col("d").alias("entry_date"), F.col("close").alias("entry_price"),
        F.array(*[F.struct(F.lead("d", h).over(w).alias("d"), F.lead("close", h).over(w).alias("close")) for h in holds]).alias("_out"),
    )
    joined = entries.join(priced, ["ticker", "entry_date"]).withColumn("_x", F.element_at("_out", F.col("_h") + 1))
    joined = joined.withColumns({"exit_date": F.col("_x.d"), "exit_price": F.col("_x.close")})
    return _filled(joined, per_trade)
