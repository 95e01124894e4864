"""Per-key selection and totals that stay safe when one key holds most rows.

Nothing here puts an unbounded group into one task: picks are aggregates with
map-side combine, top-N is limited before each shuffle and salted, and group
totals are aggregated and joined back instead of computed in a window over the
whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import require


def pick_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], *, last: bool = True
) -> DataFrame:
    """One row per key: the last (or first) by *order*, as a combinable aggregate.

    *order* must single out one row. Ordered by one column, numbers are picked
    column by column, which keeps hash aggregation where the buffers allow it.
    """
    chooser = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    if len(order) == 1:
        return df.groupBy(*keys).agg(*[chooser(c, order[0]).alias(c) for c in rest])
    picked = df.groupBy(*keys).agg(
        chooser(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def top_n_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    *,
    salt_by: Sequence[str] | None = None,
    salts: int = 32,
    rank_as: str | None = None,
) -> DataFrame:
    """The first *n* rows of each key by *order*.

    ``row_number() <= n`` is planned with a group limit ahead of the shuffle (for n up to
    Spark's own threshold, 1,000), so a map task ships at most n rows of a key. With *salt_by*, a first pass ranks
    inside (key, hash of salt_by) so that the last task of a hot key sees at most
    ``salts * n`` rows however many map tasks there were.
    """
    rank = rank_as or "_rank"
    if salt_by:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            salted.withColumn(rank, F.row_number().over(first))
            .where(F.col(rank) <= n)
            .drop("_salt", rank)
        )
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(rank) <= n)
    return kept if rank_as else kept.drop(rank)


def with_totals(df: DataFrame, keys: Sequence[str], **totals: Column) -> DataFrame:
    """Attach group totals to every row of the group.

    Aggregate (combined map-side) then equi-join: one total per group travels. Small totals are
    broadcast by the planner; beyond that a group's rows meet in one partition, which
    adaptive execution streams, and unlike in a window they are never buffered. A null key is an error.
    """
    df = require(df, {f"{c} must not be null": F.col(c).isNotNull() for c in keys})
    summed = df.groupBy(*keys).agg(*[c.alias(name) for name, c in totals.items()])
    return df.join(summed, list(keys), "left")  # an inner join would filter null keys before the check


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash rows over as many partitions as the session shuffles into.

    For few small rows that each unfold into much work: sizing partitions by
    bytes, as scans and adaptive execution do, would leave them in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)
