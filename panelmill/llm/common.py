"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.session import stored

__all__ = ["stored", "table", "map_batches", "only_cache", "ship", "hot_join", "anti_by_id", "sample_by_hash", "null_safe", "MAX_BROADCAST_IDS"]

#: Ids of 8 bytes that one broadcast may hold (about 16 MB); larger sides are shuffled.
MAX_BROADCAST_IDS = 1_000_000


#: Rows that Spark hands to a Python worker at once; texts may be long, so few.
BATCH_ROWS = 2_000
class Clearable(Protocol):
    def clear(self) -> None: ...


_CACHES: dict[str, tuple[Clearable, ...]] = {}
_USED_BY: list[str] = [""]


def only_cache(name: str, *caches: Clearable) -> None:
    """Empty the word caches of other operators in this worker, which outlives their tasks, and give the memory back."""
    if _USED_BY[0] != name:
        for other, held in _CACHES.items():
            if other != name:
                for c in held:
                    c.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library keeps freed memory unless asked; not all have the call
        if trim is not None:
            trim(0)
        _CACHES[name], _USED_BY[0] = caches, name


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    top, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if top not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [top, *paths] if p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark so that any store works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """*fn* applied to every Arrow batch of *df*; it may return None for no rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def sample_by_hash(df: DataFrame, rows: int, total: int, *keys: str) -> DataFrame:
    """At most *rows* rows of *df* (of *total*), those with the smallest hashes of *keys*.

    A cut on the hash leaves about twice as many before the sort, so what the sort's tasks
    send to the driver is bounded by *rows*, however many tasks there are.
    """
    if total > 2 * rows:
        df = df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < F.lit(int((1 << 40) * 2.0 * rows / total)))
    return df.orderBy(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)), *keys).limit(rows)


def null_safe(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & a[n].eqNullSafe(b[n])
    return cond


def hot_join(left: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner", parts: int = 1000) -> DataFrame:
    """Join many rows to one row a group without a hot task.

    ``groups`` has one row per key and, in ``size``, how many rows of ``left`` the key
    has; ``total`` is the count of ``left``. Groups with more than ``total / parts``
    rows are fewer than ``parts`` by arithmetic, so they are broadcast; every other
    key has few rows and is shuffled. ``size`` is dropped from the result.
    """
    limit = max(1, total // parts)
    rest = [c for c in groups.columns if c not in keys and c != size]
    hot = groups.where(F.col(size) > limit).select(*keys, *(F.col(c).alias(f"_h_{c}") for c in rest), F.lit(True).alias("_hot"))
    cold = groups.where(F.col(size) <= limit).select(*keys, *rest, F.lit(True).alias("_cold"))
    both = left.join(F.broadcast(hot), keys, "left")
    warm = both.where("_hot IS NOT NULL").select(*left.columns, *(F.col(f"_h_{c}").alias(c) for c in rest))
    other = both.where("_hot IS NULL").select(*left.columns).join(cold, keys, how).select(*left.columns, *rest)
    return warm.unionByName(other)


def anti_by_id(docs: DataFrame, ids: DataFrame, key: str, n_ids: int, how: str = "left_anti") -> DataFrame:
    """Rows of *docs* without (or with, ``left_semi``) a match in *ids*, nulls equal.

    The ids are broadcast only if their count, checked before, is below the bound;
    else both sides are shuffled on the key.
    """
    side = ids.select(F.col(key).alias("_id"))
    if n_ids <= MAX_BROADCAST_IDS:
        side = F.broadcast(side)
    return docs.join(side, docs[key].eqNullSafe(F.col("_id")), how)
