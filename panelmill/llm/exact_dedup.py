"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every row gets the SHA-256 of its normalised text (A-Z lower-cased, null as empty);
   the first eight bytes are its fingerprint. Rows are dealt to blocks.
2. Each block sorts its distinct fingerprints, splits them by owner (equal ranges of
   the fingerprint space) and sends one Golomb-Rice coded list to each owner.
3. An owner merges its lists, finds fingerprints that came from two blocks, and
   answers each block with a bitmap over the list that the block sent.
4. Blocks mark the rows whose bit is set (or that repeat inside the block) as suspects.
5. Only suspects are compared by bytes: their texts are grouped by the text itself.
   Copies meet in the map-side combine first, so a text that a third of all rows
   share is one row per map task after it.

Edge cases: null and empty texts are equal to each other; a null doc_id counts as the
smallest; identical rows give one output row each, of which one is kept; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import anti_by_id, hot_join, map_batches, stored

ROWS_PER_BLOCK = 200_000
PRINTS = "doc_id bigint, sha string, fp bigint"


def rice_encode(sorted_values: np.ndarray) -> tuple[int, bytes]:
    """Gaps of a sorted uint64 list as (parameter, Golomb-Rice bits): unary quotients, then remainders."""
    if len(sorted_values) == 0:
        return 0, b""
    gaps = np.diff(sorted_values, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, float(gaps.astype(np.float64).mean())))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, dtype=np.uint8)
    unary[ends] = 1
    low = gaps & np.uint64((1 << k) - 1)
    bits = ((low[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def rice_decode(k: int, n: int, data: bytes) -> np.ndarray:
    """The list that :func:`rice_encode` was given."""
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8))
    tail = (n * k + 7) // 8 * 8
    ends = np.flatnonzero(bits[: len(bits) - tail])[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    low = np.zeros(n, dtype=np.uint64)
    if k:
        rest = bits[len(bits) - tail :][: n * k].reshape(n, k).astype(np.uint64)
        low = (rest << np.arange(k, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)


def normalised(text: Column) -> Column:
    """The form in which two texts are compared: A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    shas = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass").lower()).hexdigest() for t in batch.column(1).to_pylist()]
    prints = np.array([int(s[:16], 16) for s in shas], dtype=np.uint64).view(np.int64)
    return pa.record_batch([batch.column(0), pa.array(shas, pa.string()), pa.array(prints, pa.int64())], ["doc_id", "sha", "fp"])


def _lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """``normalised`` of a batch's texts; Spark's translate takes them letter by letter."""
    return pa.record_batch([batch.column(0), pc.ascii_lower(pc.fill_null(batch.column(1), ""))], ["doc_id", "body"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, sha, fp) of every row."""
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), _digests, PRINTS)


def _owner_of(fps: np.ndarray, owners: int) -> np.ndarray:
    return ((fps >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)


def suspects_by_exchange(rows: DataFrame, blocks: int) -> DataFrame:
    """Mark the rows (doc_id, sha, fp, n) whose fingerprint some other row has as well."""
    owners = blocks
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "sha"), F.lit(blocks)).cast("int"))

    def send(key: Any, part: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(part["fp"].to_numpy().view(np.uint64))
        owner, out = _owner_of(fps, owners), []
        for o in np.unique(owner):
            mine = fps[owner == o]
            k, blob = rice_encode(mine)
            out.append((int(o), int(key[0]), len(mine), k, blob))
        return pd.DataFrame(out, columns=["owner", "block", "n", "k", "blob"])

    def answer(key: Any, lists: pd.DataFrame) -> pd.DataFrame:
        decoded = [rice_decode(k, n, b) for k, n, b in zip(lists["k"], lists["n"], lists["blob"], strict=True)]
        values, counts = np.unique(np.concatenate(decoded), return_counts=True)
        twice = values[counts > 1]
        maps = [np.packbits(np.isin(d, twice, assume_unique=True)).tobytes() for d in decoded]
        return pd.DataFrame({"block": lists["block"], "owner": lists["owner"], "bits": maps})

    def mark(key: Any, part: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        own = part["fp"].to_numpy().view(np.uint64)
        fps, back, counts = np.unique(own, return_inverse=True, return_counts=True)
        owner, hit = _owner_of(fps, owners), counts > 1
        for o, bits in zip(maps["owner"], maps["bits"], strict=True):
            at = np.flatnonzero(owner == o)
            hit[at] |= np.unpackbits(np.frombuffer(bits, dtype=np.uint8))[: len(at)].astype(bool)
        return part[["doc_id", "sha", "n"]].assign(suspect=hit[back] | (part["n"].to_numpy() > 1))

    lists = dealt.select("block", "fp").groupBy("block").applyInPandas(send, "owner int, block int, n int, k int, blob binary")
    maps = lists.groupBy("owner").applyInPandas(answer, "block int, owner int, bits binary")
    return dealt.groupBy("block").cogroup(maps.groupBy("block")).applyInPandas(mark, "doc_id bigint, sha string, n bigint, suspect boolean")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of *docs*: doc_id, keep_id, group_size, kept, text_sha256."""
    # Identical rows become one with a count, so that no doc_id can be hot.
    rows = stored(fingerprints(docs).groupBy("doc_id", "sha").agg(F.first("fp").alias("fp"), F.count("*").alias("n")), "prints")
    total = rows.count()
    marked = stored(suspects_by_exchange(rows, max(4, -(-total // ROWS_PER_BLOCK))), "marked")
    suspects = marked.where("suspect")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = anti_by_id(texts, suspects.select("doc_id").distinct(), "doc_id", suspects.count(), "left_semi")
    texts = map_batches(texts, _lowered, "doc_id bigint, body string")
    by_text = texts.groupBy("body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("size"))
    groups = by_text.select(F.sha2("body", 256).alias("sha"), "keep_id", "size")
    # Bytes have been compared: two texts with one digest would be an error, not a group.
    groups = groups.groupBy("sha").agg(
        F.when(F.count("*") > 1, F.raise_error(F.lit("two texts share a digest"))).otherwise(F.max("keep_id")).alias("keep_id"),
        F.max("size").alias("group_size"),
    ).withColumn("_rows", F.col("group_size"))
    groups = stored(groups, "groups")  # hot_join reads it twice, and it compares texts
    found = hot_join(suspects, groups, ["sha"], "_rows", total)
    single = marked.where("NOT suspect").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("bigint")})
    every = found.unionByName(single).withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)
    return every.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """*docs* without the rows that :func:`exact_dedup` drops, all columns kept.

    Rows that repeat a doc_id and its text are one document; one of them stays.
    """
    plan = stored(exact_dedup(docs), "exact")
    dropped = plan.where("NOT kept").select("doc_id")
    n = dropped.count()
    clean = anti_by_id(docs, dropped.distinct(), "doc_id", n)
    again = plan.where("kept").join(dropped.distinct(), plan["doc_id"].eqNullSafe(dropped["doc_id"]), "left_semi")
    again = again.select(F.col("doc_id").alias("_id"), "text_sha256")
    n_again = again.count()
    if n_again == 0:
        return clean
    # Rows of a repeated doc_id, of which one stays for each text.
    sha = F.sha2(normalised(F.col("text")), 256)
    some = anti_by_id(docs, again.select(F.col("_id").alias("doc_id")).distinct(), "doc_id", n_again, "left_semi")
    some = some.withColumn("_sha", sha).join(again, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("text_sha256")), "left_semi")
    return clean.unionByName(some.dropDuplicates(["doc_id", "_sha"]).drop("_sha"))
