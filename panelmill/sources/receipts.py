"""Saved run documents: write, read back, classify."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import BatchTable

STORED = "fund string, receipt_id bigint, mtime date, body string"


def receipt_table(spark: SparkSession, path: str) -> BatchTable:
    """The store of run documents: each run commits a batch, listed by fund. Bodies stay text."""
    return BatchTable(spark, path, STORED, "fund")


def write_receipts(df: DataFrame, path: str, partition_by: Sequence[str] = ("fund",), fmt: str = "json") -> None:
    """Write documents as JSON or Parquet, one folder per partition value."""
    df.write.mode("overwrite").partitionBy(*partition_by).format(fmt).save(path)


def read_receipts(spark: SparkSession, path: str, *, one_per_file: bool = True) -> DataFrame:
    """Raw document texts with the time their file changed.

    Documents stay text here: one damaged file must not fail the listing.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    return reader.text(path, wholetext=one_per_file).select(
        F.col("value").alias("body"),
        F.col("_metadata.file_modification_time").alias("mtime"),
        F.col("_metadata.file_path").alias("path"),
    )


# The fields a saved document is read for.
RECEIPT_SCHEMA = (
    "universe ARRAY<STRING>, benchmark STRING, status STRING, as_of STRING, execution_as_of STRING, nav DOUBLE, "
    "reason STRING, orders ARRAY<STRING>, proposal STRUCT<universe: ARRAY<STRING>>, start STRING, end STRING, "
    "metrics STRUCT<total_return_pct: DOUBLE, annualized_return_pct: DOUBLE, sharpe_ratio: DOUBLE, max_drawdown_pct: DOUBLE, "
    "benchmark_return_pct: DOUBLE, excess_return_pct: DOUBLE, n_cycles: BIGINT>, _damaged STRING"
)
# Headline name of each metric.
METRICS = {
    "total": "total_return_pct", "annualized": "annualized_return_pct", "sharpe": "sharpe_ratio", "maxdd": "max_drawdown_pct",
    "benchret": "benchmark_return_pct", "excess": "excess_return_pct", "n_cycles": "n_cycles",
}


def read_fields(receipts: DataFrame) -> DataFrame:
    """Kind, headline fields and ``fault`` of each document; a sound one has no fault.

    A document with metrics is a backtest, one marked pending is a proposal, anything else a run. The
    document is parsed once: what is exploded is not merged into later expressions.
    """
    options = {"columnNameOfCorruptRecord": "_damaged"}
    tagged = receipts.withColumn("_d", F.explode(F.array(F.from_json("body", RECEIPT_SCHEMA, options))))
    whole = F.col("_d").isNotNull() & F.col("_d._damaged").isNull() & F.startswith(F.ltrim("body"), F.lit("{"))
    kind = (
        F.when(F.col("_d.metrics").isNotNull(), "backtest")
        .when(F.col("_d.status") == "pending", "pending")
        .otherwise("run")
    )
    tagged = tagged.withColumn("kind", kind).withColumn("_whole", F.coalesce(whole, F.lit(False)))
    backtest, pending, run = (F.col("kind") == k for k in ("backtest", "pending", "run"))
    fields = tagged.select(
        *receipts.columns,
        "kind", "_whole",
        F.when(pending, F.col("_d.proposal.universe"))
        .otherwise(F.coalesce("_d.universe", F.array().cast("array<string>"))).alias("universe"),
        F.when(run, F.coalesce("_d.execution_as_of", "_d.as_of")).when(pending, F.col("_d.as_of")).alias("as_of"),
        F.when(run, F.col("_d.nav")).alias("nav"),
        F.when(run, F.when(F.col("_d.orders").isNotNull(), F.size("_d.orders")).otherwise(0)).alias("n_orders"),
        F.when(pending, F.col("_d.reason")).alias("reason"),
        F.when(backtest, F.coalesce("_d.start", F.lit(""))).alias("start"),
        F.when(backtest, F.coalesce("_d.end", F.lit(""))).alias("end"),
        *[F.when(backtest, F.col(f"_d.metrics.{field}")).alias(name) for name, field in METRICS.items()],
        F.when(backtest, F.coalesce("_d.benchmark", F.lit("SPY"))).alias("benchmark"),
    )
    complete = F.expr(
        f"CASE kind WHEN 'backtest' THEN {' AND '.join(f'{m} IS NOT NULL' for m in METRICS)} "
        "WHEN 'pending' THEN as_of IS NOT NULL AND reason IS NOT NULL AND universe IS NOT NULL "
        "ELSE as_of IS NOT NULL AND nav IS NOT NULL END"
    )
    fault = F.when(~F.col("_whole"), "not a JSON object").when(~complete, F.concat("kind", F.lit(" lacks a field it needs")))
    return fields.withColumn("fault", fault).drop("_whole")


def summarize_receipts(receipts: DataFrame) -> DataFrame:
    """Kind and headline fields of each sound document; ``quarantined_receipts`` has the others."""
    return read_fields(receipts).where("fault IS NULL").drop("fault")


def quarantined_receipts(receipts: DataFrame) -> DataFrame:
    """Documents that cannot be used, as they were given, with their fault."""
    return read_fields(receipts).where("fault IS NOT NULL").select(*receipts.columns, "fault")


def last_run_per_fund(summaries: DataFrame, tie: str = "mtime") -> DataFrame:
    """Last non-empty universe and last backtest score of each fund."""
    order = F.struct("mtime", tie)
    named = F.size("universe") > 0
    scored = F.col("kind") == "backtest"
    score = F.struct("total", "excess", "benchmark")
    return (
        summaries.groupBy("fund")
        .agg(
            F.max_by(F.when(named, F.col("universe")), F.when(named, order)).alias("universe"),
            F.max_by(F.when(scored, score), F.when(scored, order)).alias("_s"),
        )
        .select("fund", "universe", "_s.total", "_s.excess", "_s.benchmark")
    )
