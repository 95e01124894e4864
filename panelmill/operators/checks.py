"""Fail-loud conditions, as a violations table or as a stop."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """True where a number is present and neither NaN nor infinite."""
    good = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.coalesce(value.isNotNull() & good, F.lit(False))


def violations(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """(keys, rule) for each row and rule that does not hold; unknown counts as broken."""
    broken = [
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()
    ]
    return df.select(*keys, F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def require(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """The same rows, or a job failure that names the first broken rule.

    The check rides on a filter in the plan, so it costs no extra pass.
    """
    for name, ok in rules.items():
        held = F.coalesce(ok, F.lit(False))
        df = df.where(F.when(held, F.lit(True)).otherwise(F.raise_error(F.lit(name)).cast("boolean")))
    return df


def missing_keys(needed: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key rows that should exist and do not."""
    return needed.select(*keys).distinct().join(present, list(keys), "left_anti")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, with the side; empty means the sets are equal."""
    only_left = left.exceptAll(right).withColumn("side", F.lit("left"))
    return only_left.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
