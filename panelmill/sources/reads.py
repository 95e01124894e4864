"""Point-in-time reads: bars, filings, metrics, news, sessions.

Filters are plain predicates on date and key columns so that they reach the
Parquet scan; limits per ticker are applied before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import pick_per_key, top_n_per_key


def scan_bars(bars: DataFrame, start: str, end: str, tickers: DataFrame | None = None) -> DataFrame:
    """Bars in an inclusive date range, optionally of the listed tickers only."""
    ranged = bars.where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return ranged if tickers is None else ranged.join(tickers, "ticker", "left_semi")


_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def bar_start(when: Column, interval: str, multiplier: int = 1) -> Column:
    """Start of the bar that holds a timestamp."""
    if interval in _MONTHS:
        size = _MONTHS[interval] * multiplier
        months = (F.year(when) - 1970) * 12 + F.month(when) - 1
        return F.add_months(F.lit("1970-01-01").cast("date"), (F.floor(months / size) * size).cast("int"))
    seconds = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800}[interval] * multiplier
    offset = 4 * 86400 if interval == "week" else 0  # weeks start on Monday
    epoch = F.unix_seconds(when.cast("timestamp"))
    return F.timestamp_seconds(F.floor((epoch - offset) / seconds) * seconds + offset)


def resample_bars(
    ticks: DataFrame, interval: str, multiplier: int = 1, *, tie: str, when: str = "ts",
) -> DataFrame:
    """Open, high, low, close and volume per ticker and interval.

    First and last are picked by (time, tie) inside the aggregate, so each map
    task ships one row per ticker and bar.
    """
    order = F.struct(when, tie)
    return ticks.groupBy("ticker", bar_start(F.col(when), interval, multiplier).alias("bar")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("volume").alias("volume"),
    )


def newest_per_ticker(
    facts: DataFrame, n: int, order: Sequence[str], *, keys: Sequence[str] = ("ticker",), salt_by: str | None = None,
) -> DataFrame:
    """Newest *n* rows per ticker by the listed columns, all descending."""
    newest = [F.col(c).desc() for c in order]
    return top_n_per_key(facts, list(keys), newest, n, salt_by=[salt_by] if salt_by else None)


def filed_metrics(
    metrics: DataFrame, as_of: str, period: str = "ttm", limit: int = 10, tie: str = "filing_id"
) -> DataFrame:
    """Metrics already filed on *as_of*, newest first, at most *limit* per ticker."""
    known = metrics.where(
        (F.col("filing_date") <= F.lit(as_of).cast("date")) & (F.col("period") == period)
    )
    return newest_per_ticker(known, limit, ["filing_date", "report_period", tie], salt_by=tie)


def dated_facts(
    facts: DataFrame, day: str, end: str, start: str | None = None, limit: int = 1000, *, tie: str
) -> DataFrame:
    """News or insider rows in a date range with an optional start, newest per ticker."""
    until = F.col(day) <= F.lit(end).cast("date")
    ranged = facts.where(until if start is None else until & (F.col(day) >= F.lit(start).cast("date")))
    return newest_per_ticker(ranged, limit, [day, tie], salt_by=tie)


def with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Left lookup of the latest company attributes; the join strategy is left to size statistics."""
    return rows.join(facts, "ticker", "left")


def latest_earnings(filings: DataFrame) -> DataFrame:
    """The newest filing of each ticker."""
    return pick_per_key(
        filings, ["ticker"], [F.col("report_period"), F.col("filing_date"), F.col("filing_id")]
    )


def market_cap_asof(metrics: DataFrame, as_of: str) -> DataFrame:
    """Market cap of the last filed metrics row; current-day caps are never read."""
    known = metrics.where(F.col("filing_date") <= F.lit(as_of).cast("date"))
    return known.groupBy("ticker").agg(
        F.max_by("market_cap", F.struct("filing_date", "report_period", "filing_id")).alias("market_cap")
    )


def session_closes(
    bars: DataFrame, benchmark: str, start: str, end: str, *, when: str = "d"
) -> DataFrame:
    """Benchmark sessions: last close of each day; a bad close stops the job."""
    day = F.col(when).cast("date")
    closes = (
        bars.where(F.col("ticker") == benchmark)
        .where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy(day.alias("d"))
        .agg(F.max_by("close", when).alias("close"))
    )
    usable = (F.col("close") > 0) & ~F.isnan("close") & (F.col("close") < F.lit(float("inf")))
    checked = F.when(F.coalesce(usable, F.lit(False)), F.col("close")).otherwise(
        F.raise_error(F.concat(F.lit("close must be finite and positive on "), F.col("d").cast("string")))
    )
    return closes.select("d", checked.cast("double").alias("close"))


def normalize_universe(tickers: DataFrame, ticker: str = "ticker", position: str = "pos") -> DataFrame:
    """Trimmed upper-case tickers, each once, at its first position."""
    clean = F.upper(F.trim(F.col(ticker)))
    return tickers.where(clean != "").groupBy(clean.alias("ticker")).agg(F.min(position).alias("pos"))


def completed_days(rows: DataFrame, now: Column, day: str = "d") -> DataFrame:
    """Rows dated before the current New York date."""
    today = F.to_date(F.from_utc_timestamp(now, "America/New_York"))
    return rows.where(F.col(day) <= F.date_sub(today, 1))


def only_new_work(requests: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests without an answer fetched after their end date was over in New York."""
    fetched = F.to_date(F.from_utc_timestamp("fetched_at", "America/New_York"))
    complete = done.where(fetched > F.col("end_date"))
    return requests.join(complete.select(*keys), list(keys), "left_anti")
