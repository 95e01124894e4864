"""Event studies: market-model fit, abnormal returns, windows and group statistics.

Moments of the estimation window and sums of the event windows are kept on the
(ticker, day) return panel. Events then need one equi-join on (ticker, day)
instead of a range join that copies 240 rows per event, and an event-heavy
ticker stays spread over its days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.student_t import t_p_value
from .asof import snap_forward
from .checks import finite
from .keyed import spread, top_n_per_key, with_totals
from .moments import block_parts, placed_parts, sums_ahead, window_before
from .running import dense_index, id_blocks
from .series import aligned_closes, aligned_returns, per_ticker, returns_of

# Fixed values of the study design.
RETROSPECTIVE_DAYS = 45
ESTIMATION_FIRST, ESTIMATION_LAST = -250, -11
SNAP_DAYS = 4
LAST_OFFSET = 20
PRICE_RANGE = (400, 35)
WINDOWS = {"[0,+1]": ("car_0_1", 1), "[0,+5]": ("car_0_5", 5), "[0,+20]": ("car_0_20", 20)}

_FIT_FIELDS = ("alpha", "beta", "r_squared", "n_obs")


def drop_retrospective(filings: DataFrame, days: int = RETROSPECTIVE_DAYS) -> DataFrame:
    """Keep filings made fewer than *days* after the period they report."""
    return filings.where(F.datediff("filing_date", "report_period") < days)


def ols_from_moments(n: Column, mx: Column, my: Column, mxx: Column, mxy: Column, myy: Column) -> Column:
    """Line fit from centred moments: struct of alpha, beta, r_squared, n_obs.

    A market that never moves gives beta 0 and alpha the mean; r_squared is 0 where the ticker never
    moves. Spreads below the rounding of their squares count as zero.
    """
    moves_x, moves_y = mxx > 1e-24 * n * mx * mx, myy > 1e-24 * n * my * my
    beta = F.when(moves_x, mxy / mxx).otherwise(0.0)
    r2 = F.when(moves_x & moves_y, (mxy / mxx) * (mxy / myy)).otherwise(0.0)
    return F.struct(
        (my - beta * mx).alias("alpha"), beta.alias("beta"), r2.alias("r_squared"), n.cast("bigint").alias("n_obs")
    )


def fit_groups(rows: DataFrame, keys: Sequence[str], y: str = "y", x: str = "x") -> DataFrame:
    """Market-model fit of explicit return rows, one line per group."""
    fitted = rows.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("_b"),
        F.regr_intercept(y, x).alias("_a"),
        F.regr_r2(y, x).alias("_r"),
        F.avg(y).alias("_m"),
        F.count("*").alias("n_obs"),
        F.var_pop(x).alias("_vx"),
        F.var_pop(y).alias("_vy"),
    )
    flat = F.coalesce(F.col("_vx") == 0, F.lit(True))
    return fitted.select(
        *keys,
        F.when(flat, F.col("_m")).otherwise(F.col("_a")).alias("alpha"),
        F.when(flat, 0.0).otherwise(F.col("_b")).alias("beta"),
        F.when(flat | (F.col("_vy") == 0), 0.0).otherwise(F.col("_r")).alias("r_squared"),
        "n_obs",
    )


WIDTH = ESTIMATION_LAST - ESTIMATION_FIRST + 1


def _asked_days(closes: DataFrame, filings: DataFrame) -> DataFrame:
    """*closes* with ``_asked``, the latest filing date of the ticker up to the row's day.

    Filing dates, each once, stand in one line with the ticker's days, so calendar days bound the window.
    """
    dates = filings.select("ticker", F.col("filing_date").alias("d"), F.lit(True).alias("_date")).distinct()
    line = closes.withColumn("_date", F.lit(False)).unionByName(dates, allowMissingColumns=True)
    upto = Window.partitionBy("ticker").orderBy("d", F.desc("_date")).rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("_asked", F.max(F.when(F.col("_date"), F.col("d"))).over(upto)).where(~F.col("_date")).drop("_date")


def return_panel(bars: DataFrame, market: DataFrame, filings: DataFrame | None = None) -> DataFrame:
    """Aligned returns with their moments by blocks; days without two finite returns enter none.

    With *filings* each row has ``_asked``, the latest filing date up to its day.
    """
    good = finite(F.col("y")) & finite(F.col("x"))
    if filings is None:
        return block_parts(aligned_returns(bars, market), good, WIDTH)
    return block_parts(returns_of(_asked_days(aligned_closes(bars, market), filings), "_asked"), good, WIDTH)


def _placed(panel: DataFrame, ends: Sequence[int] = ()) -> DataFrame:
    return placed_parts(panel, WIDTH, -ESTIMATION_LAST, ends, per_ticker())


def estimation_moments(panel: DataFrame) -> DataFrame:
    """Per (ticker, day): moments over the estimation window, where it is complete and all its days are good."""
    est = {f"est_{f}": c for f, c in window_before(WIDTH, -ESTIMATION_LAST).items()}
    return _placed(panel).select("ticker", "d", "idx", *[c.alias(n) for n, c in est.items()]).where(F.col("est_bad") == 0)


def _event_table(panel: DataFrame, path: bool = False) -> DataFrame:
    """Everything an event needs, one row per eligible day and filing date that snaps to it.

    Days that no filing snaps to go before anything is computed for them. An event window that runs past
    the data, or holds a day without returns, is null. With *path* the row holds ``_path``, the returns at offsets
    0..LAST_OFFSET, null past the data.
    """
    ends = dict(WINDOWS.values())
    over = per_ticker()
    ahead = [F.lead(F.struct("y", "x"), k).over(over).alias(f"_at{k}") for k in range(LAST_OFFSET + 1)] if path else []
    placed = _placed(panel.select("*", F.lag("d").over(over).alias("_earlier"), *ahead), list(ends.values()))
    first = F.greatest(F.date_sub("d", SNAP_DAYS), F.date_add("_earlier", 1))  # a null has no say
    cols = {f"est_{f}": c for f, c in window_before(WIDTH, -ESTIMATION_LAST).items()}
    sums = {name: sums_ahead(WIDTH, end) for name, end in ends.items()}
    cols |= {f"{name}_{s}": F.when(found["bad"] == 0, found[s]) for name, found in sums.items() for s in "yx"}
    kept = ["ticker", "d", "idx", "_first"] + (["_path"] if path else [])
    asked = placed.withColumn("_first", first).where(F.col("_asked") >= F.col("_first"))
    if path:
        asked = asked.withColumn("_path", F.array(*[f"_at{k}" for k in range(LAST_OFFSET + 1)]))
    found = asked.select(*kept, *[c.alias(n) for n, c in cols.items()]).where(F.col("est_bad") == 0)
    fit = ols_from_moments(*[F.col(f"est_{m}") for m in ("n", "mx", "my", "mxx", "mxy", "myy")]).alias("fit")
    table = found.select(*kept, fit, *[f"{name}_{s}" for name in sums for s in "yx"])
    return table.withColumn("filing_date", F.explode(F.sequence("_first", "d"))).drop("_first")


def newest_filings(filings: DataFrame, limit: int) -> DataFrame:
    """The newest *limit* filings of each ticker overall, whatever date is asked about."""
    order = [F.desc("filing_date"), F.desc("report_period"), F.desc("filing_id")]
    return top_n_per_key(filings, ["ticker"], order, limit, salt_by=["filing_id"])


def bars_around(bars: DataFrame, filings: DataFrame, days: tuple[int, int]) -> DataFrame:
    """Bars of each ticker from *days[0]* before its first filing to *days[1]* after its last."""
    spans = filings.groupBy("ticker").agg(
        F.date_sub(F.min("filing_date"), days[0]).alias("_from"), F.date_add(F.max("filing_date"), days[1]).alias("_to")
    )
    return bars.join(spans, "ticker").where(F.col("d").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def event_study(
    filings: DataFrame, bars: DataFrame, market: DataFrame, *, earnings_limit: int | None = None,
    require_eps_surprise: bool = False, price_range: tuple[int, int] | None = None, daily_path: bool = False,
) -> DataFrame:
    """One row per usable filing: fit, day 0 and cumulative abnormal returns.

    Filings under the retrospective rule are snapped forward to a return day at
    most SNAP_DAYS later and need the whole estimation window before it. A
    window that runs past the data is null.

    Options: only the newest *earnings_limit* filings of a ticker; only filings with a surprise
    label in the result; only bars within *price_range* days around a ticker's kept filings (PRICE_RANGE is
    the span a study needs), which moves the first day that an estimation window can start on. With *daily_path*
    each event has ``daily_ar``, its abnormal returns at offsets 0..LAST_OFFSET as far as data reaches (``daily_rows``
    unfolds them).
    """
    if earnings_limit is not None:
        filings = newest_filings(filings, earnings_limit)
    kept = drop_retrospective(filings)
    if price_range is not None:
        bars = bars_around(bars, kept, price_range)
    if require_eps_surprise:
        kept = kept.where(F.col("eps_surprise").isNotNull())
    table = _event_table(return_panel(bars, market, kept), daily_path)
    events = kept.join(table, ["ticker", "filing_date"])
    cars = [
        (
            F.col(f"{name}_y")
            - (end + 1) * F.col("fit.alpha")
            - F.col("fit.beta") * F.col(f"{name}_x")
        ).alias(name)
        for name, end in WINDOWS.values()
    ]
    # Above the join, where the fit is a column: below it, its formula would be worked out for each offset.
    there = F.filter("_path", lambda r: r.isNotNull())
    ar = F.transform(there, lambda r: r["y"] - (F.col("fit.alpha") + F.col("fit.beta") * r["x"])).alias("daily_ar")
    return events.select(
        "filing_id", "ticker", "filing_date", "report_period", "source_type", "eps_surprise",
        F.col("d").alias("event_day"), "idx",
        *[F.col(f"fit.{f}").alias(f) for f in _FIT_FIELDS],
        *cars, *([ar] if daily_path else []),
    )


def daily_rows(events: DataFrame) -> DataFrame:
    """``abnormal_returns`` of events that hold their ``daily_ar``: unfolded in place, without a join."""
    # No path is empty; the outer form spares a filter that would work the path out twice.
    return events.select("filing_id", "ticker", "source_type", F.posexplode_outer("daily_ar").alias("off", "ar"))


def abnormal_returns(events: DataFrame, returns: DataFrame) -> DataFrame:
    """Daily abnormal returns at offsets 0..LAST_OFFSET, as far as data reaches.

    Each event is unfolded to its 21 day indexes and met on (ticker, idx).
    """
    wanted = events.select(
        "filing_id", "ticker", "source_type", "alpha", "beta", F.col("idx").alias("_idx0"),
        F.explode(F.sequence(F.lit(0), F.lit(LAST_OFFSET))).alias("off"),
    ).withColumn("idx", F.col("_idx0") + F.col("off"))
    return wanted.join(returns.select("ticker", "idx", "y", "x"), ["ticker", "idx"]).select(
        "filing_id", "ticker", "source_type", "off",
        (F.col("y") - (F.col("alpha") + F.col("beta") * F.col("x"))).alias("ar"),
    )


def car_windows(daily: DataFrame, keys: Sequence[str] = ("filing_id",)) -> DataFrame:
    """Window sums of daily abnormal returns; null unless the window is complete."""
    return daily.groupBy(*keys).agg(
        *[
            F.when(F.max("off") >= end, F.sum(F.when(F.col("off") <= end, F.col("ar")))).alias(name)
            for name, end in WINDOWS.values()
        ]
    )


def with_daily_path(events: DataFrame, daily: DataFrame) -> DataFrame:
    """Attach each event's abnormal returns as an array ordered by offset (21 at most)."""
    paths = daily.groupBy("filing_id").agg(
        F.array_sort(F.collect_list(F.struct("off", "ar"))).alias("_p")
    )
    return events.join(paths, "filing_id").withColumn("daily_ar", F.col("_p.ar")).drop("_p")


def car_rows(events: DataFrame) -> DataFrame:
    """(filing_id, source_type, window, car) rows, one for each event and window; a missing window is null."""
    pairs = ", ".join(f"'{label}', {name}" for label, (name, _) in WINDOWS.items())
    return events.selectExpr("filing_id", "source_type", f"stack({len(WINDOWS)}, {pairs}) AS (window, car)")


def car_long(events: DataFrame) -> DataFrame:
    """(filing_id, source_type, window, car) rows, without missing windows."""
    return car_rows(events).where("car IS NOT NULL")


def car_stats(events: DataFrame) -> DataFrame:
    """Count, mean and sample deviation per source type and window (2 or more events)."""
    # One pass: every event has a row for each window, so its rows count a source's events too.
    per = car_rows(events).groupBy("source_type", "window").agg(
        F.count("*").alias("n_total"), F.count("car").alias("n_events"), F.avg("car").alias("mean_car"), F.stddev_samp("car").alias("std_car")
    )
    figures = ["window", "n_events", "mean_car", "std_car"]
    enough = F.when((F.col("n_events") >= 2) & F.col("source_type").isNotNull(), F.struct(*figures))
    listed = per.groupBy("source_type").agg(F.max("n_total").alias("n_total"), F.collect_list(enough).alias("_w"))
    shown = listed.select("source_type", "n_total", F.explode_outer("_w").alias("_w"))
    return shown.select("source_type", "n_total", *[F.col(f"_w.{c}").alias(c) for c in figures])


def car_ttest(stats: DataFrame) -> DataFrame:
    """One-sample t statistic against zero and its two-sided p-value."""
    few = F.col("n_events") < 2
    t = F.col("mean_car") / (F.col("std_car") / F.sqrt("n_events"))
    tested = stats.withColumn(
        "t_stat", F.when(few, 0.0).when(F.col("std_car") > 0, t)
    )
    return tested.withColumn(
        "p_value", F.when(few, 1.0).otherwise(t_p_value(F.col("t_stat"), F.col("n_events") - 1))
    )


# Fixed values of the draw: a prime below 2^31, so that squares fit in 63 bits, and odd multipliers.
DRAW_PRIME = 2_147_483_647
DRAW_SQL = f"((({{item}} % 1000000007) * 1000003 + {{draw}} * 7919 + {{seed}}) % {DRAW_PRIME})"
SQUARE_SQL = f"(({{x}} * {{x}} + {{c}}) % {DRAW_PRIME})"


def _draws(df: DataFrame, item: str, n_bootstrap: int, seed: int) -> DataFrame:
    """Each row once a replicate *b*, with a number 0 <= u < DRAW_PRIME drawn from (item, b, seed).

    Three squarings modulo a prime: whole-number arithmetic that stays in generated code and
    gives the same draws in any engine.
    """
    out = df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1))))
    out = out.withColumn("u", F.expr(DRAW_SQL.format(item=item, draw="CAST(b AS BIGINT)", seed=seed)))
    for c in (12_345, 67_890, 13_579):
        out = out.withColumn("u", F.expr(SQUARE_SQL.format(x="u", c=c)))
    return out


def _interval(means: DataFrame, confidence: float, n_bootstrap: int) -> DataFrame:
    lo, hi = (1 - confidence) / 2, (1 + confidence) / 2
    return means.groupBy("source_type", "window").agg(
        F.percentile("mean", F.array(F.lit(lo), F.lit(hi))).alias("_ci")
    ).select(
        "source_type", "window", F.col("_ci")[0].alias("lower"), F.col("_ci")[1].alias("upper"),
        F.lit(confidence).alias("confidence"), F.lit(n_bootstrap).cast("bigint").alias("n_bootstrap"),
    )


def bootstrap_slots(events: DataFrame) -> DataFrame:
    """CAR rows numbered from 0 inside each source type and window."""
    group = ["source_type", "window"]
    blocked, blocks = id_blocks(car_long(events), "filing_id")
    return dense_index(blocked, group, blocks, ["filing_id"], name="slot").select(*group, "slot", "car")


#: Slots in one array of values: small enough for batches of rows, and values of a group that one task may hold (8 bytes each).
BLOCK_SLOTS, MAX_HELD = 2_048, 50_000_000
#: Work rows of a group, each with all its values, and draws that are worked at once, to stay in a core's cache.
PARTS, CELLS = 16, 8_192
#: Partitions of rows that unfold into much arithmetic, whatever their bytes; each Poisson task sends its groups x replicates.
TASKS = 48


def _kernels(seed: int):
    """The numbers of ``_draws`` over arrays: what an item brings, and all draws of items (row: draw, column: item).

    Closures, so that workers get them by value. Products are reduced modulo the prime by folding upper bits.
    """
    import numpy as np

    prime, bits = np.uint64(DRAW_PRIME), np.uint64(31)

    def start(item):
        return (item % 1_000_000_007 * 1_000_003 + seed).astype(np.uint64)

    def drawn(starts, draw):
        u = starts[None, :] + draw[:, None] * np.uint64(7_919)
        high = np.empty_like(u)

        def fold():
            np.right_shift(u, bits, out=high)
            np.bitwise_and(u, prime, out=u)
            np.add(u, high, out=u)

        fold()  # below 2^50: one fold leaves less than 2^31 + 2^19, whose square fits
        for c in (12_345, 67_890, 13_579):
            np.multiply(u, u, out=u)
            np.add(u, np.uint64(c), out=u)
            fold()
            fold()  # at most the prime plus one
        np.subtract(u, prime, out=high)  # wraps round where u is below the prime
        return np.minimum(u, high, out=u).astype(np.uint32)

    return start, drawn


def _held_means(slots: DataFrame, n_bootstrap: int, seed: int) -> DataFrame:
    """Means of all replicates where a task can hold a group's values: arithmetic on arrays, no row per draw.

    Values travel as blocks of slots. Each of ``PARTS`` partitions of a group's replicates takes the blocks in slot order,
    puts them together and draws from them, so tasks follow the replicates and not the groups.
    """
    import numpy as np
    import pyarrow as pa

    def means(values, first, end):
        n, starts = len(values), start(np.arange(len(values), dtype=np.int64))
        out = np.zeros(end - first)
        for k in range(0, end - first, rows := max(1, CELLS // n)):
            b = np.arange(first + k, min(first + k + rows, end), dtype=np.uint64)
            for at in range(0, n, CELLS):
                u = drawn(starts[at : at + CELLS], b)
                u -= u // np.uint32(n) * np.uint32(n)
                out[k : k + len(b)] += values.take(u).sum(axis=1)
        return out / n

    def result(key, parts):
        source, window, first = key
        values = np.concatenate(parts)
        if len(values) < 2:
            return None
        got = means(values, first, min(first + step, n_bootstrap))
        b = np.arange(first, first + len(got), dtype=np.int32)
        return pa.record_batch(
            [pa.array([v] * len(got), pa.string()) for v in (source, window)] + [pa.array(b), pa.array(got)], ["source_type", "window", "b", "mean"])

    def run(batches):
        key, parts = None, []
        for batch in batches:
            for source, window, first, cars in zip(*[batch.column(c) for c in ("source_type", "window", "first", "cars")], strict=True):
                here = (source.as_py(), window.as_py(), first.as_py())
                if here != key and parts:
                    found = result(key, parts)
                    if found is not None:
                        yield found
                    parts = []
                key = here
                parts.append(cars.values.to_numpy(zero_copy_only=False).copy())
        if parts:
            found = result(key, parts)
            if found is not None:
                yield found

    start, drawn = _kernels(seed)
    step = -(-n_bootstrap // PARTS)
    blocks = slots.groupBy("source_type", "window", F.floor(F.col("slot") / BLOCK_SLOTS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("slot", "car"))).alias("_v")
    )
    work = blocks.select(
        "source_type", "window", "block", F.col("_v.car").alias("cars"), F.explode(F.sequence(F.lit(0), F.lit(n_bootstrap - 1), F.lit(step))).alias("first")
    )
    key = ["source_type", "window", "first"]
    return work.repartition(4 * TASKS, *key).sortWithinPartitions(*key, "block").mapInArrow(run, "source_type string, window string, b int, mean double")


def _joined_means(slots: DataFrame, n_bootstrap: int, seed: int) -> DataFrame:
    """The same means by meeting each draw with its slot, which no group can overload."""
    group = ["source_type", "window"]
    sized = spread(with_totals(slots, group, n=F.count("*")).where("n >= 2"), "slot")
    drawn = _draws(sized.select(*group, "slot", "n"), "slot", n_bootstrap, seed)
    drawn = drawn.select(*group, "b", (F.col("u") % F.col("n")).alias("slot"))
    return drawn.join(slots, [*group, "slot"]).groupBy(*group, "b").agg(F.avg("car").alias("mean"))


def bootstrap_ci(
    slots: DataFrame, *, n_bootstrap: int = 10_000, confidence: float = 0.95, seed: int = 42, max_held: int = MAX_HELD
) -> DataFrame:
    """Percentile bootstrap interval of the mean, drawing n of n with replacement.

    *slots* comes from ``bootstrap_slots``, best as a stored table. Work is n x n_bootstrap by definition of
    drawing n of n; draws come from seeded whole-number arithmetic. While no group has more than *max_held* rows
    (counted first) the draws run over arrays of values, beyond it each draw meets its slot in a join; both give
    the same replicates. ``bootstrap_ci_poisson`` does less arithmetic and holds no group.
    """
    largest = slots.groupBy("source_type", "window").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    means = _held_means if largest <= max_held else _joined_means
    return _interval(means(slots, n_bootstrap, seed), confidence, n_bootstrap)


# 2^32 times the cumulative Poisson(1) probabilities for 0, 1, 2, ... copies; a draw is scaled to 2^32.
POISSON_CUTS = (
    1580030169, 3160060337, 3950075422, 4213413783, 4279248374,
    4292415292, 4294609778, 4294923276, 4294962463, 4294966817, 4294967253, 4294967292,
)


def poisson_copies(u: Column) -> Column:
    """How often a row enters a replicate, from a uniform 32-bit number."""
    copies = F.lit(len(POISSON_CUTS))
    for k in reversed(range(len(POISSON_CUTS))):
        copies = F.when(u < POISSON_CUTS[k], k).otherwise(copies)
    return copies


def bootstrap_ci_poisson(
    events: DataFrame, *, n_bootstrap: int = 10_000, confidence: float = 0.95, seed: int = 42
) -> DataFrame:
    """The same interval for very large groups, with Poisson(1) row weights.

    Weights are drawn row by row, so replicates are plain weighted means: each task draws for its rows over
    arrays and adds them up, and only groups x replicates rows of each task are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    start, draws = _kernels(seed)
    columns = [name for name, _ in WINDOWS.values()]
    # w = k for cuts[k - 1] <= 2u < cuts[k]; the scaled number is even, so halves of the cuts do, rounded up.
    cuts = [-(-c // 2) for c in POISSON_CUTS]

    def sums_of(ids, cars, out):
        starts, known = start(ids), ~np.isnan(cars[1])
        both = np.concatenate([np.where(known, cars[0], 0.0), known.astype(np.float64)])
        rows = max(1, CELLS // len(ids))
        for k in range(0, n_bootstrap, rows):
            u = draws(starts, np.arange(k, min(k + rows, n_bootstrap), dtype=np.uint64))
            w = np.zeros(u.shape, dtype=np.int8)
            for cut in cuts:
                w += (u >= np.uint32(cut)).view(np.int8)
            out[k : k + len(u)] += w.astype(np.float64) @ both.T

    def run(batches):
        totals = {}
        for batch in batches:
            ids = batch.column("filing_id").to_numpy()
            sources = np.array(batch.column("source_type").to_pylist(), dtype=object)
            there = np.array([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in columns])
            values = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], dtype=np.float64)
            for source in dict.fromkeys(sources):
                at = np.flatnonzero(np.array([s == source for s in sources]))
                out = totals.setdefault(source, np.zeros((n_bootstrap, 2 * len(columns))))
                for i in range(0, len(at), 512):
                    few = at[i : i + 512]
                    sums_of(ids[few], (values[:, few], np.where(there[:, few], 0.0, np.nan)), out)
        for source, out in totals.items():
            yield pa.record_batch(
                [pa.array([source] * n_bootstrap, pa.string()), pa.array(np.arange(n_bootstrap, dtype=np.int32)), *[pa.array(c.copy()) for c in out.T]], names)

    names = ["source_type", "b", *[f"{c}_s" for c in columns], *[f"{c}_n" for c in columns]]
    few = events.select("filing_id", "source_type", *columns).repartition(TASKS, "filing_id")
    drawn = few.mapInArrow(run, "source_type string, b int, " + ", ".join(f"{c} double" for c in names[2:]))
    sums = drawn.groupBy("source_type", "b").agg(*[F.sum(c).alias(c) for c in names[2:]])
    pairs = ", ".join(f"'{label}', try_divide({c}_s, {c}_n)" for label, (c, _) in WINDOWS.items())
    means = sums.selectExpr("source_type", "b", f"stack({len(WINDOWS)}, {pairs}) AS (window, mean)")
    return _interval(means.where("mean IS NOT NULL"), confidence, n_bootstrap)


def car_histogram(events: DataFrame, window: str = "[0,+1]", bins: int = 20) -> DataFrame:
    """Equal-width bins of CAR percent per source type, empty bins included."""
    name, _ = WINDOWS[window]
    values = events.select("source_type", (F.col(name) * 100).alias("v")).where("v IS NOT NULL")
    span = values.groupBy("source_type").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean_pct")
    )
    flat = F.col("hi") == F.col("lo")
    spread = span.select(
        "source_type", "mean_pct",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    place = F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    counts = (
        values.join(spread, "source_type")
        .groupBy("source_type", F.least(place, F.lit(bins - 1)).cast("bigint").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    grid = spread.select(
        "source_type", "lo", "hi", "mean_pct",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"),
    )
    return grid.join(counts, ["source_type", "bin"], "left").select(
        "source_type", "bin",
        (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("left_edge"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "mean_pct",
    )


def car_path(daily: DataFrame) -> DataFrame:
    """Mean cumulative abnormal return by offset, with one standard error, in percent.

    A series that ends early is carried flat, so every offset counts all events.
    """
    return car_path_of(daily.groupBy("source_type", "filing_id").agg(F.array_sort(F.collect_list(F.struct("off", "ar"))).alias("_p")).select(
        "source_type", F.col("_p.ar").alias("daily_ar")
    ))


def car_path_of(events: DataFrame) -> DataFrame:
    """``car_path`` of events that hold their ``daily_ar``: offsets without a gap from 0, none empty.

    Every event has a row for each of the LAST_OFFSET + 1 offsets; those past the longest series of its source go after
    the sums, so only sources x offsets rows of a task travel.
    """
    held = events.select("source_type", F.transform("daily_ar", lambda v: F.coalesce(v, F.lit(0.0))).alias("_ar")).where(F.col("source_type").isNotNull())
    steps = F.sequence(F.lit(0), F.lit(LAST_OFFSET))
    cum = F.aggregate(
        steps, F.array().cast("array<double>"),
        lambda done, k: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)) + F.coalesce(F.get("_ar", k), F.lit(0.0)))),
    )
    paths = held.select("source_type", F.size("_ar").alias("_n"), F.posexplode_outer(cum).alias("off", "cum"))
    return paths.groupBy("source_type", "off").agg(
        F.max("_n").alias("_last"), F.count("*").alias("n"),
        (F.avg("cum") * 100).alias("mean_pct"),
        (F.stddev_samp("cum") / F.sqrt(F.count("*")) * 100).alias("se_pct"),
    ).where("off < _last").drop("_last")


def car_bars(stats: DataFrame, intervals: DataFrame) -> DataFrame:
    """Mean CAR percent with distances to its interval; 0 where a window is missing."""
    labels = ", ".join(f"'{w}'" for w in WINDOWS)
    grid = stats.select("source_type").distinct().selectExpr(
        "source_type", f"explode(array({labels})) AS window"
    )
    known = stats.where("window IS NOT NULL").join(
        intervals.select("source_type", "window", "lower", "upper"), ["source_type", "window"]
    )
    mean = F.col("mean_car")
    return grid.join(known, ["source_type", "window"], "left").select(
        "source_type", "window",
        *[
            F.coalesce(e * 100, F.lit(0.0)).alias(name)
            for name, e in (
                ("mean_pct", mean), ("below_pct", mean - F.col("lower")), ("above_pct", F.col("upper") - mean)
            )
        ],
    )


def skipped_tickers(filings: DataFrame, events: DataFrame) -> DataFrame:
    """Tickers asked for that produced no event."""
    return filings.select("ticker").distinct().join(events.select("ticker").distinct(), "ticker", "left_anti")


def gate_history(
    filings: DataFrame, bars: DataFrame, market: DataFrame, min_days: int = 220
) -> DataFrame:
    """Filings with the reason they cannot be studied, or 'ok'."""
    returns = aligned_returns(bars, market)
    depth = returns.groupBy("ticker").agg((F.count("*") + 1).alias("aligned_days"))
    day0 = snap_forward(
        filings.select("filing_id", "ticker", "filing_date"),
        returns.select("ticker", "d", "idx"), ["ticker"], "d", "filing_date", tolerance=SNAP_DAYS,
    ).select("filing_id", "idx")
    return (
        filings.join(depth, "ticker", "left")
        .join(day0, "filing_id", "left")
        .withColumn(
            "reason",
            F.when(F.coalesce("aligned_days", F.lit(0)) < min_days, "too few aligned days")
            .when(F.col("idx").isNull(), "no trading day after the filing")
            .when(F.col("idx") + ESTIMATION_FIRST < 0, "short estimation window")
            .otherwise("ok"),
        )
    )
