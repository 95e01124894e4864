from pyspark.sql import functions as F


def test_tasks_follow_bytes_and_not_a_fixed_count(spark):
    # 4 shuffle partitions are set; about 50 MB that do not compress have to be dealt over more of them.
    rows = spark.range(3_000_000).select(F.xxhash64("id").alias("k"), F.xxhash64("id", F.lit(1)).alias("v"))
    assert rows.repartition("k").rdd.getNumPartitions() > 4
    assert rows.limit(100).repartition("k").rdd.getNumPartitions() <= 4
