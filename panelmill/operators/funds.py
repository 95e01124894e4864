"""Fund-level schedules and performance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import drawdown, rebalance_days


def next_session(sessions: DataFrame, day: str = "d") -> DataFrame:
    """Each session with the following one; null on the last. One row per day, so one small sort."""
    w = Window.partitionBy(F.lit(1)).orderBy(day)
    return sessions.withColumn("next_session", F.lead(day).over(w))


def schedule_table(sessions: DataFrame, cadence: str) -> DataFrame:
    """Sessions with their close, whether they rebalance, and where that executes."""
    picked = rebalance_days(sessions, cadence).withColumn("rebalances", F.lit(True))
    joined = next_session(sessions).join(picked, "d", "left")
    rebalances = F.coalesce("rebalances", F.lit(False))
    return joined.select(
        "d", "close", rebalances.alias("rebalances"),
        F.when(rebalances, F.col("next_session")).alias("execution_date"),
    )


def assessment_dates(schedule: DataFrame) -> DataFrame:
    """Rebalance days and the days before executions, each once."""
    rebalanced = schedule.where("rebalances")
    before = rebalanced.where("execution_date IS NOT NULL").select(F.date_sub("execution_date", 1).alias("d"))
    return rebalanced.select("d").union(before).distinct()


def pending_proposals(schedule: DataFrame, assessed: DataFrame, keys: Sequence[str] = ("fund", "date")) -> DataFrame:
    """Assessments made on a rebalance day that has no later session to execute on."""
    open_days = schedule.where("rebalances AND execution_date IS NULL").select(F.col("d").alias("date"))
    return assessed.select(*keys).distinct().join(open_days, "date", "left_semi").withColumn(
        "reason", F.lit("no later session inside the window")
    )


def fund_metrics(nav: DataFrame, capital: Column, activity: DataFrame | None = None) -> DataFrame:
    """Performance over the whole window from (fund, session, nav, benchmark_nav) rows.

    Sharpe uses daily returns between observed sessions and the root of 252.
    """
    w = Window.partitionBy("fund").orderBy("session")
    returned = drawdown(nav, ["fund"], "session", "nav").withColumn(
        "_r", F.col("nav") / F.lag("nav").over(w) - 1
    )
    sums = returned.groupBy("fund").agg(
        F.max_by("nav", "session").alias("_end"), F.max_by("benchmark_nav", "session").alias("_bench"),
        F.datediff(F.max("session"), F.min("session")).alias("_days"),
        F.avg("_r").alias("_mean"), F.stddev_samp("_r").alias("_std"), F.count("_r").alias("_n"),
        F.max("drawdown").alias("_dd"), F.count("*").alias("n_sessions"),
    )
    total, bench = F.col("_end") / capital - 1, F.col("_bench") / capital - 1
    years = F.col("_days") / 365.25
    annual = F.when(years > 0, F.pow(1 + total, 1 / years) - 1).otherwise(0.0)
    sharpe = F.when((F.col("_n") > 1) & (F.col("_std") > 0), F.col("_mean") / F.col("_std") * F.sqrt(F.lit(252.0)))
    out = sums.select(
        "fund", F.round(total, 6).alias("total_return_pct"), F.round(annual, 6).alias("annualized_return_pct"),
        F.round(F.coalesce(sharpe, F.lit(0.0)), 4).alias("sharpe_ratio"),
        F.round(F.greatest("_dd", F.lit(0.0)), 6).alias("max_drawdown_pct"),
        F.round(bench, 6).alias("benchmark_return_pct"), F.round(total - bench, 6).alias("excess_return_pct"),
        "n_sessions",
    )
    return out if activity is None else out.join(activity, "fund", "left")


def expanding_fund_metrics(nav: DataFrame, capital: Column) -> DataFrame:
    """Fund metrics over the sessions so far, for every session."""
    w = Window.partitionBy("fund").orderBy("session")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    base = drawdown(nav, ["fund"], "session", "nav").withColumn("_r", F.col("nav") / F.lag("nav").over(w) - 1)
    run = base.select(
        "fund", "session", "nav", "benchmark_nav",
        F.datediff("session", F.min("session").over(upto)).alias("_days"),
        F.avg("_r").over(upto).alias("_mean"), F.stddev_samp("_r").over(upto).alias("_std"),
        F.count("_r").over(upto).alias("_n"), F.max("drawdown").over(upto).alias("_dd"),
    )
    total, years = F.col("nav") / capital - 1, F.col("_days") / 365.25
    annual = F.when(years > 0, F.pow(1 + total, 1 / years) - 1).otherwise(0.0)
    sharpe = F.when((F.col("_n") > 1) & (F.col("_std") > 0), F.col("_mean") / F.col("_std") * F.sqrt(F.lit(252.0)))
    return run.select(
        "fund", "session", F.round(total, 6).alias("total_return_pct"),
        F.round(annual, 6).alias("annualized_return_pct"),
        F.round(F.coalesce(sharpe, F.lit(0.0)), 4).alias("sharpe_ratio"), F.round("_dd", 6).alias("max_drawdown_pct"),
        F.round(F.col("benchmark_nav") / capital - 1, 6).alias("benchmark_return_pct"),
    )
