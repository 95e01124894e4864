"""Centred second moments of fixed-length windows, without subtracting running sums.

A window of ``width`` rows is the end of one block of ``width`` rows and the beginning of the next. Each
row keeps the moments (n, means, centred squares and products) from its block's start to itself and from
itself to its block's end; a window's moments are those of the two parts merged. Only rows inside
the window enter them, so an outlier elsewhere in the series costs no digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("n", "mx", "my", "mxx", "mxy", "myy", "bad")


def _running(over: Window, good: Column, x: Column, y: Column) -> list[Column]:
    gx, gy = F.when(good, x), F.when(good, y)
    n = F.count(gx).over(over)
    zero = F.lit(0.0)
    return [
        n,
        F.coalesce(F.avg(gx).over(over), zero), F.coalesce(F.avg(gy).over(over), zero),
        F.coalesce(F.var_pop(gx).over(over) * n, zero),
        F.coalesce(F.covar_pop(gx, gy).over(over) * n, zero),
        F.coalesce(F.var_pop(gy).over(over) * n, zero),
        F.sum(F.when(good, 0).otherwise(1)).over(over),
    ]


def merged(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Moments of two disjoint sets of rows put together; either may be empty."""
    n = a["n"] + b["n"]
    share = F.when(n > 0, b["n"] / n).otherwise(0.0)
    dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
    both = a["n"] * share
    return {
        "n": n, "mx": a["mx"] + dx * share, "my": a["my"] + dy * share,
        "mxx": a["mxx"] + b["mxx"] + dx * dx * both,
        "mxy": a["mxy"] + b["mxy"] + dx * dy * both,
        "myy": a["myy"] + b["myy"] + dy * dy * both,
        "bad": a["bad"] + b["bad"],
    }


def block_parts(rows: DataFrame, good: Column, width: int, keys: Sequence[str] = ("ticker",), index: str = "idx") -> DataFrame:
    """*rows* with ``_upto`` and ``_onward``: moments of x and y from the block's start to the row and from it to the end.

    ``index`` counts the rows of a key without gaps from 0; blocks hold ``width`` of them. Rows that are not good enter
    no moment and are counted in ``bad``.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(index) / width)).withColumn("_good", F.coalesce(good, F.lit(False)))
    x, y, ok = F.col("x"), F.col("y"), F.col("_good")
    for name, order in (("_upto", F.asc(index)), ("_onward", F.desc(index))):
        over = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        fields = [c.alias(f) for f, c in zip(FIELDS, _running(over, ok, x, y), strict=True)]
        blocked = blocked.withColumn(name, F.struct(*fields))
    return blocked.drop("_block", "_good")


def placed_parts(parts: DataFrame, width: int, last: int, ends: Sequence[int], over: Window) -> DataFrame:
    """*parts* beside the parts that its windows are made of, each looked up once.

    ``_end`` and ``_start`` belong to the *width* rows that end *last* rows before this one, ``_prev`` to the
    row before, ``_up<k>`` to the row k ahead, for each k in *ends*.
    """
    return parts.select(
        "*", F.lag("_upto", last).over(over).alias("_end"), F.lag("_onward", last + width - 1).over(over).alias("_start"),
        F.lag("_upto", 1).over(over).alias("_prev"), *[F.lead("_upto", k).over(over).alias(f"_up{k}") for k in ends],
    )


def window_before(width: int, last: int, index: str = "idx") -> dict[str, Column]:
    """Moments of the *width* rows that end *last* rows before, from ``placed_parts``; null where cut short."""
    whole = F.pmod(F.col(index) - last, F.lit(width)) == width - 1  # the window is one block
    b = {f: F.col(f"_end.{f}") for f in FIELDS}
    a = {f: F.when(whole, F.lit(0)).otherwise(F.col(f"_start.{f}")) for f in FIELDS}
    there = F.col(index) - last - width + 1 >= 0
    return {f: F.when(there, c) for f, c in merged(a, b).items()}


def sums_ahead(width: int, end: int, index: str = "idx") -> dict[str, Column]:
    """Sums of x and y and the count of bad rows over offsets 0..end (less than a block); null where cut short.

    Across a border both parts are sums as they stand; within a block the part before the row is taken off.
    """
    place = F.pmod(F.col(index), F.lit(width))

    def total(part: str, f: str) -> Column:
        return F.col(f"{part}.bad") if f == "bad" else F.col(f"{part}.n") * F.col(f"{part}.m{f}")

    def of(f: str) -> Column:
        earlier = F.when(place > 0, total("_prev", f)).otherwise(F.lit(0))
        ahead = total(f"_up{end}", f)
        return F.when(place + end < width, ahead - earlier).otherwise(total("_onward", f) + ahead)

    return {f: of(f) for f in ("x", "y", "bad")}
