"""As-of joins with a tolerance, and interval joins, as equi-joins.

A quote that is the latest known on several calendar days is unfolded to those
days (``lead`` gives the end, the tolerance caps it), so a request meets at most
one row on an exact (key, day). The window behind ``lead`` runs over one row per
(key, day), which calendar days bound; requests of a hot key stay spread over days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(
    quotes: DataFrame, keys: Sequence[str], day: str, *, tolerance: int, as_of: str = "as_of", dates: DataFrame | None = None
) -> DataFrame:
    """Each quote on every day it is the latest, at most *tolerance* days on.

    *quotes* holds one row per (keys, day). Output is unique on (keys, as_of). With *dates* (a column *as_of*, at most one
    row per calendar day, broadcast on that bound) only those days are made, so that a quote that meets none does not travel.
    """
    ahead = F.lead(day).over(Window.partitionBy(*keys).orderBy(day))
    last = F.least(F.date_sub(ahead, 1), F.date_add(F.col(day), tolerance))
    if dates is not None:
        near = dates.select(as_of).distinct().withColumn(day, F.explode(F.sequence(F.date_sub(as_of, tolerance), F.col(as_of))))
        return quotes.withColumn("_last", last).join(F.broadcast(near), day).where(F.col(as_of) <= F.col("_last")).select(*quotes.columns, as_of)
    return quotes.withColumn("_last", last).withColumn(
        as_of, F.explode(F.sequence(F.col(day), F.col("_last")))
    ).drop("_last")


def on_dates(keys: DataFrame, dates: DataFrame, day: str, name: str | None = None) -> DataFrame:
    """Every key row on every listed date.

    The dates, at most one per calendar day, come in as one array literal and
    each row is unfolded in place: no join and no shuffle of the keys.
    """
    listed = dates.agg(F.array_sort(F.collect_set(day))).scalar()
    return keys.withColumn("_dates", listed).withColumn(name or day, F.explode("_dates")).drop("_dates")


def asof_backward(
    requests: DataFrame,
    quotes: DataFrame,
    keys: Sequence[str],
    day: str,
    *,
    tolerance: int,
    as_of: str = "as_of",
    how: str = "left",
) -> DataFrame:
    """Latest quote with day in [as_of - tolerance, as_of] for each request."""
    known = carry_forward(quotes, keys, day, tolerance=tolerance, as_of=as_of)
    return requests.join(known, [*keys, as_of], how)


def snap_forward(
    requests: DataFrame,
    days: DataFrame,
    keys: Sequence[str],
    day: str,
    request_day: str,
    *,
    tolerance: int,
) -> DataFrame:
    """Inner join of each request to its first listed day within the tolerance.

    *days* has one row per (keys, day). A request is unfolded to its candidate
    days; the match that has no listed day between the request and itself is the
    first one, known from the previous listed day without any grouping.
    """
    earlier = F.lag(day).over(Window.partitionBy(*keys).orderBy(day))
    listed = days.withColumn("_earlier", earlier)
    candidates = requests.withColumn(
        day,
        F.explode(F.sequence(F.col(request_day), F.date_add(F.col(request_day), tolerance))),
    )
    return (
        candidates.join(listed, [*keys, day])
        .where(F.col("_earlier").isNull() | (F.col("_earlier") < F.col(request_day)))
        .drop("_earlier")
    )


def spans_on_dates(
    spans: DataFrame, dates: DataFrame, day: str, first: str, last: str, name: str
) -> DataFrame:
    """Each span of days on every listed date it covers, unfolded in place."""
    listed = dates.agg(F.array_sort(F.collect_set(day))).scalar()
    return (
        spans.withColumn("_dates", listed)
        .withColumn(name, F.explode(F.filter("_dates", lambda d: d.between(F.col(first), F.col(last)))))
        .drop("_dates")
    )


def _months(first: Column, last: Column) -> Column:
    return F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("INTERVAL 1 MONTH"))


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    *,
    start: str = "seg_start",
    end: str = "seg_end",
) -> DataFrame:
    """Pairs of day spans (inclusive ends) of one key that overlap, with the overlap.

    Both sides are cut by calendar month and joined on (keys, month); a pair is
    kept only in the month where its overlap starts, so it appears once.
    """
    lf, lt = left_span
    rf, rt = right_span
    cut_left = left.withColumn("_month", F.explode(_months(F.col(lf), F.col(lt))))
    cut_right = right.withColumn("_month", F.explode(_months(F.col(rf), F.col(rt))))
    joined = cut_left.join(cut_right, [*keys, "_month"])
    return (
        joined.withColumn(start, F.greatest(lf, rf))
        .withColumn(end, F.least(lt, rt))
        .where((F.col(start) <= F.col(end)) & (F.col("_month") == F.trunc(start, "MM")))
        .drop("_month")
    )


def newest_lists(
    grid: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    day: str,
    tie: Sequence[str],
    *,
    n: int,
    as_of: str = "as_of",
    name: str = "known",
) -> DataFrame:
    """*grid* with the *n* newest facts dated on or before as_of, as a list of structs, newest first.

    Facts and requests of a key are put in one line by day; a fact's place in it is its number, and a request
    takes the facts of the last n numbers. So a fact travels once, and not once for each request that it is
    known to. At most n facts per (keys, day) can ever matter; the rest are dropped by rank first, which
    bounds the per-key window by n rows a day. A request with a null key or date has an empty list.
    """
    newest_first = [F.col(t).desc() for t in tie]
    per_day = Window.partitionBy(*keys, day).orderBy(*newest_first)
    dated = facts.where(F.col(day).isNotNull())
    for c in keys:
        dated = dated.where(F.col(c).isNotNull())
    useful = dated.withColumn("_r", F.row_number().over(per_day)).where(F.col("_r") <= n).drop("_r")
    fields = [c for c in facts.columns if c not in keys]
    asked = [c for c in grid.columns if c not in keys]
    line = useful.select(
        *keys, F.col(day).alias("_day"), F.lit(0).alias("_asks"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie)],
        F.struct(*fields).alias("_fact"), F.lit(None).cast(grid.select(F.struct(*asked).alias("_")).schema["_"].dataType).alias("_request"),
    ).unionByName(
        grid.select(*keys, F.col(as_of).alias("_day"), F.lit(1).alias("_asks"), F.struct(*asked).alias("_request")),
        allowMissingColumns=True,
    )
    in_time = Window.partitionBy(*keys).orderBy("_day", "_asks", *[f"_tie{i}" for i in range(len(tie))])
    numbered = line.select(
        *keys, "_asks", "_fact", "_request",
        F.count("_fact").over(in_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_number"),
    )
    last = Window.partitionBy(*keys).orderBy("_number").rangeBetween(1 - n, 0)
    found = numbered.withColumn(name, F.collect_list("_fact").over(last)).where("_asks = 1")
    return found.select(*keys, *[F.col(f"_request.{c}").alias(c) for c in asked], F.reverse(name).alias(name))


def newest_known(
    grid: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    day: str,
    tie: Sequence[str],
    *,
    n: int,
    as_of: str = "as_of",
) -> DataFrame:
    """For each (keys, as_of) the *n* newest facts dated on or before as_of, ranked: ``newest_lists`` as rows."""
    listed = newest_lists(grid, facts, keys, day, tie, n=n, as_of=as_of, name="_known")
    rows = listed.select(*grid.columns, F.posexplode("_known").alias("_at", "_fact"))
    fields = [c for c in facts.columns if c not in keys]
    return rows.select(*grid.columns, *[F.col(f"_fact.{c}").alias(c) for c in fields], (F.col("_at") + 1).alias("rank"))
