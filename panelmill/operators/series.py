"""Return series, day indexes and rolling statistics per ticker.

Inputs hold one row per (ticker, d), so a per-ticker window sees at most one row
a calendar day whatever the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_ticker(*keys: str, day: str = "d") -> Window:
    return Window.partitionBy(*(keys or ("ticker",))).orderBy(day)


def aligned_closes(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Closes of each ticker beside the market's, on days both traded.

    The market side is grouped to one row per calendar day (about 100 bytes a day,
    so a century stays near 4 MB) and is broadcast on that bound. A day that a market
    table holds twice counts with its larger close.
    """
    days = market.groupBy("d").agg(F.max("close").alias("market_close"))
    return bars.select("ticker", "d", "close").join(F.broadcast(days), "d")


def shared_days(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Days of every ticker on which the market traded too."""
    days = market.select("d").distinct()
    return bars.select("ticker", "d").distinct().join(F.broadcast(days), "d", "left_semi").select("ticker", "d")


def aligned_returns(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Simple returns y (ticker) and x (market) with their 0-based day index.

    A return from a zero close is null: it harms the windows that hold it, not the job.
    """
    return returns_of(aligned_closes(bars, market))


def returns_of(closes: DataFrame, *kept: str) -> DataFrame:
    """``aligned_returns`` of closes that stand beside the market's, with the columns *kept*."""
    w = per_ticker()
    returns = closes.select(
        "ticker",
        "d",
        F.try_divide(F.col("close") - F.lag("close").over(w), F.lag("close").over(w)).alias("y"),
        F.try_divide(
            F.col("market_close") - F.lag("market_close").over(w), F.lag("market_close").over(w)
        ).alias("x"),
        (F.row_number().over(w) - 2).cast("bigint").alias("idx"),
        *kept,
    )
    return returns.where("idx >= 0")


def exit_at(bars: DataFrame, k: int) -> DataFrame:
    """The day and close k trading days ahead; null past the end of the data."""
    w = per_ticker()
    return bars.select(
        "ticker",
        "d",
        "close",
        F.lead("d", k).over(w).alias("exit_date"),
        F.lead("close", k).over(w).alias("exit_price"),
    )


def rebalance_days(days: DataFrame, cadence: str, day: str = "d") -> DataFrame:
    """Every day, or the last listed day of each ISO week or calendar month."""
    if cadence == "daily":
        return days.select(day).distinct()
    periods = {
        "weekly": (F.expr(f"extract(YEAROFWEEK FROM {day})"), F.expr(f"extract(WEEK FROM {day})")),
        "monthly": (F.year(day), F.month(day)),
    }
    if cadence not in periods:
        raise ValueError(f"unknown rebalance cadence {cadence!r}")
    year, period = periods[cadence]
    return days.groupBy(year.alias("_y"), period.alias("_p")).agg(F.max(day).alias(day)).select(day)


def relative_strength(bars: DataFrame, period: int = 14) -> DataFrame:
    """RSI from simple rolling means; 50 while undefined, 100 without losses."""
    w = per_ticker()
    frame = w.rowsBetween(-(period - 1), 0)
    delta = F.col("close") - F.lag("close").over(w)
    moves = bars.select(
        "ticker",
        "d",
        F.coalesce(F.greatest(delta, F.lit(0.0)), F.lit(0.0)).alias("gain"),
        F.coalesce(F.greatest(-delta, F.lit(0.0)), F.lit(0.0)).alias("loss"),
    )
    means = moves.select(
        "ticker",
        "d",
        F.avg("gain").over(frame).alias("gain"),
        F.avg("loss").over(frame).alias("loss"),
        F.count("*").over(frame).alias("n"),
    )
    rsi = (
        F.when((F.col("n") < period) | ((F.col("gain") == 0) & (F.col("loss") == 0)), 50.0)
        .when(F.col("loss") == 0, 100.0)
        .otherwise(100.0 - 100.0 / (1.0 + F.col("gain") / F.col("loss")))
    )
    return means.select("ticker", "d", rsi.alias("rsi"))


def drawdown(curve: DataFrame, keys: Sequence[str], day: str, value: str) -> DataFrame:
    """Running peak and the fall from it, for curves with one row per (keys, day)."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    peaked = curve.withColumn("peak", F.max(value).over(w))
    return peaked.withColumn("drawdown", (F.col("peak") - F.col(value)) / F.col("peak"))


def scaled_benchmark(sessions: DataFrame, capital: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Capital that follows the benchmark close from the first session on."""
    if not keys:
        return sessions.withColumn(
            "benchmark_nav", capital * F.col("close") / sessions.agg(F.min_by("close", "d")).scalar()
        )
    first = sessions.groupBy(*keys).agg(F.min_by("close", "d").alias("_base"))
    joined = sessions.join(first, list(keys))
    return joined.withColumn("benchmark_nav", capital * F.col("close") / F.col("_base")).drop("_base")


def onset(signals: DataFrame, active: Column, keys: Sequence[str] = ("ticker",), day: str = "d") -> DataFrame:
    """Rows where the signal turns on after a flat day (or on the first day)."""
    w = Window.partitionBy(*keys).orderBy(day)
    marked = signals.withColumn("active", active)
    return marked.withColumn(
        "onset", F.col("active") & ~F.coalesce(F.lag("active").over(w), F.lit(False))
    )


def resample_curve(
    curves: DataFrame, keys: Sequence[str], day: str, value: str, points: int
) -> DataFrame:
    """Each curve at *points* evenly spaced positions, linearly interpolated.

    Curve points of one key are days, so numbering them is bounded; the blend is
    two equi-joins on (keys, position).
    """
    w = Window.partitionBy(*keys).orderBy(day)
    numbered = curves.select(*keys, (F.row_number().over(w) - 1).alias("_j"), F.col(value).alias("_v"))
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("_n"))
    step = (F.col("_n") - 1).cast("double") / F.lit(float(points - 1))
    grid = (
        sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("_pos", F.col("i") * step)
        .withColumn("_lo", F.floor("_pos").cast("int"))
        .withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n").cast("int") - 1))
    )
    low = numbered.select(*keys, F.col("_j").alias("_lo"), F.col("_v").alias("_vlo"))
    high = numbered.select(*keys, F.col("_j").alias("_hi"), F.col("_v").alias("_vhi"))
    frac = F.col("_pos") - F.col("_lo")
    return (
        grid.join(low, [*keys, "_lo"])
        .join(high, [*keys, "_hi"])
        .select(*keys, F.col("i").cast("bigint").alias("i"),
                (F.col("_vlo") * (1 - frac) + F.col("_vhi") * frac).alias("value"))
    )
