"""Target weights to delta orders, and the checks before they are accepted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import finite
from .running import dense_index

BOOK = ("fund", "session")


def join_targets_positions(
    targets: DataFrame, positions: DataFrame, keys: Sequence[str] = (*BOOK, "ticker")
) -> DataFrame:
    """Every name wanted or held; a missing side is zero, so an untargeted holding closes."""
    return targets.join(positions, list(keys), "full").select(
        *keys, F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("shares", F.lit(0).cast("bigint")).alias("shares"),
    )


def exact_marks(needed: DataFrame, bars: DataFrame, day: str = "session", order: str | None = None) -> DataFrame:
    """Close of each needed (ticker, session) on exactly that day, with a reason where unusable.

    Of several bars on a day the last by *order* counts; without an order they must agree.
    """
    close = F.max_by("close", order) if order else F.max("close")
    differ = F.lit(False) if order else F.min("close") != F.max("close")
    closes = bars.groupBy("ticker", F.col("d").alias(day)).agg(close.alias("mark"), differ.alias("_differ"))
    joined = needed.join(closes, ["ticker", day], "left")
    return joined.withColumn(
        "reason",
        F.when(F.col("mark").isNull(), "missing close")
        .when(F.col("_differ"), "several closes on the day")
        .when(~(finite(F.col("mark")) & (F.col("mark") > 0)), "close must be finite and positive"),
    ).drop("_differ")


def unusable_baskets(marks: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Baskets that cannot trade because a name of theirs has no usable mark, with the count and one reason."""
    bad = marks.where(F.col("reason").isNotNull())
    return bad.groupBy(*keys).agg(F.count("*").alias("n_unusable"), F.min("reason").alias("reason"))


def basket_marks(marks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Marks of whole baskets: one bad mark fails every name of its basket, which then has no mark.

    ``basket_reason`` names the fault of the basket, ``reason`` that of the name itself.
    """
    failed = unusable_baskets(marks, keys).select(*keys, "n_unusable", F.col("reason").alias("basket_reason"))
    joined = marks.join(failed, list(keys), "left")
    return joined.withColumn("n_unusable", F.coalesce("n_unusable", F.lit(0).cast("bigint"))).withColumn(
        "mark", F.when(F.col("basket_reason").isNull(), F.col("mark"))
    )


def delta_orders(books: DataFrame, keys: Sequence[str] = BOOK) -> DataFrame:
    """Whole-share orders from (weight, shares, mark, equity) rows, without the sequence.

    Target shares are cut toward zero; names already on target give no order.
    """
    target = (F.col("weight") * F.col("equity") / F.col("mark")).cast("bigint")
    delta = F.col("target_shares") - F.col("shares")
    return (
        books.withColumn("target_shares", target)
        .withColumn("delta", delta)
        .where("delta <> 0")
        .select(
            *keys, "ticker",
            F.when(F.col("delta") > 0, "buy").otherwise("sell").alias("side"),
            F.abs("delta").alias("quantity"),
            F.col("mark").alias("price"),
        )
    )


def order_sequence(orders: DataFrame, keys: Sequence[str] = BOOK) -> DataFrame:
    """Number the orders of a book: sells before buys, then by ticker.

    Numbering runs over (side, leading characters of the ticker) blocks, so a
    book of any size is spread.
    """
    blocked = orders.withColumn("_side", F.when(F.col("side") == "sell", 0).otherwise(1)).withColumn(
        "_head", F.substring("ticker", 1, 3)
    )
    return dense_index(blocked, keys, ["_side", "_head"], ["ticker"], name="seq", start=1).drop("_side", "_head")


def signed_quantity(side: Column, quantity: Column) -> Column:
    return F.when(side == "buy", quantity).otherwise(-quantity)


def projected_violations(
    books: DataFrame, orders: DataFrame, funds: DataFrame, keys: Sequence[str] = BOOK, tolerance: float = 1e-9
) -> DataFrame:
    """Limits a book would break after its orders; empty means they may be sent."""
    moves = orders.select(*keys, "ticker", signed_quantity(F.col("side"), F.col("quantity")).alias("_move"))
    after = books.join(moves, [*keys, "ticker"], "left").join(
        funds.select("fund", "max_position_pct", "max_gross_exposure"), "fund"
    )
    weight = (F.col("shares") + F.coalesce("_move", F.lit(0))) * F.col("mark") / F.col("equity")
    weighted = after.withColumn("projected", weight)
    names = weighted.where(F.abs("projected") > F.col("max_position_pct") + tolerance).select(
        *keys, F.lit("max_position_pct").alias("limit"), "ticker",
        F.col("projected").alias("observed"), F.col("max_position_pct").alias("bound"),
    )
    gross = (
        weighted.groupBy(*keys)
        .agg(F.sum(F.abs("projected")).alias("observed"), F.max("max_gross_exposure").alias("bound"))
        .where(F.col("observed") > F.col("bound") + tolerance)
        .select(*keys, F.lit("max_gross_exposure").alias("limit"), F.lit(None).cast("string").alias("ticker"),
                "observed", "bound")
    )
    return names.unionByName(gross)


def split_tradeable(requests: DataFrame, marks: DataFrame, keys: Sequence[str] = ("ticker", "as_of"), days: int = 7):
    """(tradeable, skipped): names with a mark, and the others with a reason."""
    has = marks.select(*keys)
    skipped = requests.join(has, list(keys), "left_anti").withColumn(
        "reason", F.concat(F.lit(f"no close within {days} days of "), F.col(keys[-1]).cast("string"))
    )
    return requests.join(has, list(keys), "left_semi"), skipped


def execution_views(dates: DataFrame, assessed: DataFrame) -> DataFrame:
    """The assessment that each execution uses: the one made the day before it."""
    cutoffs = dates.withColumn("date", F.date_sub("execution_date", 1))
    return cutoffs.join(assessed, ["fund", "date"])
