"""Running totals and dense row numbers without one-task groups.

A plain window ``partitionBy(key).orderBy(t)`` sends all rows of a key to one
task. Here the key is cut into consecutive blocks (a day, a range of ids): block
totals are combined map-side, a small window runs over blocks, and only the rows
of one block share a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .checks import require

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(kind: str, earlier: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(earlier, F.lit(0)) + here
    return F.greatest(earlier, here) if kind == "max" else F.least(earlier, here)


def _openings(
    totals: DataFrame, by: list[str], blocks: list[str], kinds: Mapping[str, str]
) -> DataFrame:
    """For each block, every value accumulated over all earlier blocks of the key."""
    within = Window.partitionBy(*by, *blocks[:-1]) if by or blocks[:-1] else Window.partitionBy(F.lit(1))
    before = within.orderBy(blocks[-1]).rowsBetween(Window.unboundedPreceding, -1)
    local = totals.select(
        *by, *blocks, *[_COMBINE[k](c).over(before).alias(c) for c, k in kinds.items()]
    )
    if len(blocks) == 1:
        return local
    outer_keys = by + blocks[:-1]
    coarse = totals.groupBy(*outer_keys).agg(*[_COMBINE[k](c).alias(c) for c, k in kinds.items()])
    opened = _openings(coarse, by, blocks[:-1], kinds).select(
        *outer_keys, *[F.col(c).alias(f"{c}__outer") for c in kinds]
    )
    merged = {
        c: (
            F.when(
                F.col(c).isNull() & F.col(f"{c}__outer").isNull(), F.lit(None)
            ).otherwise(_merge(k, F.col(f"{c}__outer"), F.coalesce(F.col(c), F.lit(0))))
            if k == "sum"
            else _merge(k, F.col(f"{c}__outer"), F.col(c))
        )
        for c, k in kinds.items()
    }
    return local.join(opened, outer_keys).select(
        *by, *blocks, *[v.alias(c) for c, v in merged.items()]
    )


def running(
    df: DataFrame,
    by: Sequence[str],
    blocks: Sequence[str],
    order: Sequence[str | Column],
    values: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Inclusive running values inside *by*, ordered by (blocks, order).

    *values* maps an output column to ``(kind, input column)`` with kind one of
    sum, max, min. Each block column must follow the order: all rows of a block
    come before all rows of the next.
    """
    by, blocks = list(by), list(blocks)
    df = require(df, {f"{c} must not be null": F.col(c).isNotNull() for c in (*by, *blocks)})
    kinds = {name: kind for name, (kind, _) in values.items()}
    totals = df.groupBy(*by, *blocks).agg(
        *[_COMBINE[kind](col).alias(name) for name, (kind, col) in values.items()]
    )
    opened = _openings(totals, by, blocks, kinds).select(
        *by, *blocks, *[F.col(n).alias(f"{n}__open") for n in values]
    )
    here = (
        Window.partitionBy(*by, *blocks)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = df.join(opened, by + blocks, "left")  # an inner join would filter null keys before the check
    for name, (kind, col) in values.items():
        out = out.withColumn(
            name, _merge(kind, F.col(f"{name}__open"), _COMBINE[kind](col).over(here))
        ).drop(f"{name}__open")
    return out


def id_blocks(df: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """*df* with three levels of blocks over a whole-number column, and their names.

    Each level splits the one above into at most 65,536 parts, so that no window over blocks
    or rows is longer than that, however sparse the numbers are.
    """
    names = [f"_{column}_{bits}" for bits in (48, 32, 16)]
    parts = {n: F.shiftright(F.col(column).cast("bigint"), bits) for n, bits in zip(names, (48, 32, 16), strict=True)}
    return df.withColumns(parts), names


def dense_index(
    df: DataFrame, by: Sequence[str], blocks: Sequence[str], order: Sequence[str | Column],
    *, name: str = "idx", start: int = 0,
) -> DataFrame:
    """Consecutive numbers inside *by* following (blocks, order), from *start*."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return (
        running(ones, by, blocks, order, {name: ("sum", "_one")})
        .withColumn(name, (F.col(name) - 1 + start).cast("bigint"))
        .drop("_one")
    )


def share_below(
    df: DataFrame, by: Sequence[str], value: str, *, blocks: int = 64, name: str = "pct_rank", digits: int | None = None
) -> DataFrame:
    """Percent of the group's values strictly below each row's value.

    With *digits*, the percent is rounded half up from whole numbers, so that no tie falls by the error of a division.

    Equal values are merged into counts first, then counts run over blocks of the
    value axis whose borders are the group's own quantiles, so neither ties nor a large or
    skewed group meet in one task. The borders are stored: approximate quantiles depend on the order in which
    partial ones arrive, and totals and rows must lie in the same blocks. Rows without a value or a key have no rank and stay.
    """
    by = list(by)
    known = df.where(F.col(value).isNotNull())
    for c in by:
        known = known.where(F.col(c).isNotNull())
    borders = known.groupBy(*by).agg(
        F.percentile_approx(value, [i / blocks for i in range(1, blocks)], F.lit(1000)).alias("_borders")
    )
    borders = stored(borders, "borders")
    counts = (
        known.groupBy(*by, value)
        .agg(F.count("*").alias("_same"))
        .join(borders, by)
        .withColumn("_block", F.size(F.filter("_borders", lambda b: b < F.col(value))))
        .drop("_borders")
    )
    below = running(counts, by, ["_block"], [value], {"_upto": ("sum", "_same")})
    totals = known.groupBy(*by).agg(F.count("*").alias("_all"))
    share = (F.col("_upto") - F.col("_same")) / F.col("_all") * 100.0
    if digits is not None:
        twice = 200 * 10**digits
        share = F.expr(f"((_upto - _same) * {twice}L + _all) div (2 * _all)") / F.lit(10.0**digits)
    ranked = below.join(totals, by).select(*by, value, share.alias(name))
    return df.join(ranked, [*by, value], "left")
