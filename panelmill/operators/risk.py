"""Hard limits on a book: per-name cap, gross cap, and the audit of what fired."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import finite, require
from .keyed import with_totals

BOOK = ["fund", "date"]


def _limited(book: DataFrame, funds: DataFrame) -> DataFrame:
    """The book beside its fund's limits, which must exist and be finite and positive."""
    held = book.join(funds.select("fund", "max_position_pct", "max_gross_exposure"), "fund", "left")
    cap, limit = F.col("max_position_pct"), F.col("max_gross_exposure")
    return require(held, {
        "position limit must be finite, positive and at most 1": finite(cap) & (cap > 0) & (cap <= 1),
        "gross limit must be finite and positive": finite(limit) & (limit > 0),
        "weight must be finite": finite(F.col("netted")),
    })


def _gross_is_number(sized: DataFrame, *columns: str) -> DataFrame:
    """Finite weights may still add up beyond what a double holds."""
    return require(sized, {"gross exposure must be finite": finite(sum((F.col(c) for c in columns), F.lit(0.0)))})


def clamp_positions(book: DataFrame, funds: DataFrame) -> DataFrame:
    """Cap each name, then scale the whole book if its gross is still too high.

    Removed exposure goes to no other name.
    """
    limited = _limited(book, funds)
    w, cap = F.col("netted"), F.col("max_position_pct")
    capped = limited.withColumn("capped", F.when(F.abs(w) > cap, F.signum(w) * cap).otherwise(w))
    sized = _gross_is_number(with_totals(capped, BOOK, gross=F.sum(F.abs("capped"))), "gross")
    limit = F.col("max_gross_exposure")
    scale = F.when(F.col("gross") > limit, limit / F.col("gross")).otherwise(1.0)
    return sized.withColumn("final", F.col("capped") * scale).withColumn("factor", F.lit(None).cast("double"))


def scale_proportional(book: DataFrame, funds: DataFrame) -> DataFrame:
    """Shrink the whole book by one factor until the largest name and the gross fit."""
    limited = _limited(book, funds)
    sized = with_totals(
        limited, BOOK, _largest=F.max(F.abs("netted")), _gross=F.sum(F.abs("netted"))
    )
    sized = _gross_is_number(sized, "_gross")
    cap, limit = F.col("max_position_pct"), F.col("max_gross_exposure")
    first = F.when(F.col("_largest") > 0, F.least(F.lit(1.0), cap / F.col("_largest"))).otherwise(1.0)
    staged = sized.withColumn("_first", first).withColumn("gross", F.col("_gross") * F.col("_first"))
    second = F.when(F.col("gross") > limit, limit / F.col("gross")).otherwise(1.0)
    return (
        staged.withColumn("capped", F.col("netted") * F.col("_first"))
        .withColumn("factor", F.col("_first") * second)
        .withColumn("final", F.col("capped") * second)
        .drop("_largest", "_gross", "_first")
    )


def apply_limits(book: DataFrame, funds: DataFrame, proportional: DataFrame) -> DataFrame:
    """Each fund by its own rule: one common factor, or cap and rescale.

    Both rules read the same totals, so a single pass serves all funds.
    """
    limited = _limited(book, funds).join(proportional, "fund", "left")
    limited = require(limited, {"fund has no strategies": F.col("proportional").isNotNull()})
    w, cap, limit = F.col("netted"), F.col("max_position_pct"), F.col("max_gross_exposure")
    capped = limited.withColumn("_clip", F.when(F.abs(w) > cap, F.signum(w) * cap).otherwise(w))
    sized = with_totals(
        capped, BOOK, _largest=F.max(F.abs("netted")), _gross=F.sum(F.abs("netted")),
        _clipped=F.sum(F.abs("_clip")),
    )
    sized = _gross_is_number(sized, "_gross", "_clipped")
    first = F.when(
        F.col("proportional") & (F.col("_largest") > 0), F.least(F.lit(1.0), cap / F.col("_largest"))
    ).otherwise(1.0)
    staged = (
        sized.withColumn("_first", first)
        .withColumn("capped", F.when(F.col("proportional"), w * F.col("_first")).otherwise(F.col("_clip")))
        .withColumn("gross", F.when(F.col("proportional"), F.col("_gross") * F.col("_first")).otherwise(F.col("_clipped")))
    )
    second = F.when(F.col("gross") > limit, limit / F.col("gross")).otherwise(1.0)
    return (
        staged.withColumn("final", F.col("capped") * second)
        .withColumn("factor", F.when(F.col("proportional"), F.col("_first") * second))
        .drop("_clip", "_largest", "_gross", "_clipped", "_first")
    )


def clamp_audit(risked: DataFrame) -> DataFrame:
    """One row per limit that fired; a gross row has no ticker.

    The value after a position limit is the one before any gross scaling.
    """
    fired = risked.where(F.abs("netted") > F.col("max_position_pct")).select(
        *BOOK, F.lit("max_position_pct").alias("limit"), "ticker",
        F.col("netted").alias("before"), F.col("capped").alias("after"),
    )
    gross = (
        risked.groupBy(*BOOK)
        .agg(F.max("gross").alias("before"), F.max("max_gross_exposure").alias("after"))
        .where(F.col("before") > F.col("after"))
        .select(*BOOK, F.lit("max_gross_exposure").alias("limit"), F.lit(None).cast("string").alias("ticker"),
                "before", "after")
    )
    return fired.unionByName(gross)
