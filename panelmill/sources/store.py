"""Tables that grow by committed batches.

A batch is written whole into its own folder and counts only once the manifest names it, so a
failed or repeated run leaves nothing half done: the same batch written again replaces its own folder,
a committed batch stays as it is, and readers never see a batch that is not in the manifest.

    <path>/data/batch=<id>/<partition>=<value>/...   rows
    <path>/manifest/batch=<id>/...                    one JSON record a batch
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "rows bigint, content decimal(38,0)"
_BATCH = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,99}")


class BatchTable:
    """Rows of *schema* under *path*, partitioned by one of its columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str, partition: str):
        self.spark, self.path, self.schema, self.partition = spark, path.rstrip("/"), schema, partition

    def _read(self, folder: str, schema: str, kind: str) -> DataFrame:
        source = f"{self.path}/{folder}"
        full = f"{schema}, batch string"
        try:
            return self.spark.read.schema(full).format(kind).option("basePath", source).load(source)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], full)

    def manifest(self) -> DataFrame:
        """(batch, rows, content): one row for each committed batch; content is an order-free hash of its rows."""
        return self._read("manifest", MANIFEST, "json").select("batch", "rows", "content")

    def rows(self) -> DataFrame:
        """Rows of committed batches, with their batch."""
        return self._read("data", self.schema, "parquet").join(self.manifest().select("batch"), "batch", "left_semi")

    def append(self, rows: DataFrame, batch: str) -> int:
        """Write and commit a batch; the number of its rows. A batch that is committed already is left alone.

        Rows are read back from what was written, so the record describes the files and not a second run of the plan.
        """
        if not _BATCH.fullmatch(batch):
            raise ValueError(f"not a batch name: {batch!r}")
        done = self.manifest().where(F.col("batch") == batch).first()
        if done is not None:
            return done["rows"]
        data = f"{self.path}/data/batch={batch}"
        columns = [c.split()[0] for c in self.schema.split(", ")]
        # Few files a folder, and large folders cut by size: adaptive execution splits what the hint gathers.
        gathered = rows.select(*columns).hint("rebalance", self.partition)
        gathered.write.mode("overwrite").partitionBy(self.partition).parquet(data)
        written = self.spark.read.schema(self.schema).parquet(data)
        record = written.agg(
            F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("content")
        )
        record.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/batch={batch}")
        return self.manifest().where(F.col("batch") == batch).first()["rows"]
