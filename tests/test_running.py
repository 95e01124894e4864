"""Block-wise running values agree with plain windows and brute force."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelmill.operators.keyed import pick_per_key, top_n_per_key, with_totals
from panelmill.operators.running import dense_index, running, share_below


def rows(spark, n=600, keys=3):
    rng = random.Random(7)
    data = [(f"k{0 if rng.random() < 0.6 else rng.randrange(keys)}", rng.randrange(10), i, rng.randrange(-50, 50)) for i in range(n)]
    return spark.createDataFrame(data, "k STRING, day INT, seq BIGINT, v BIGINT")


def test_running_matches_window(spark):
    df = rows(spark).withColumn("blk", F.floor(F.col("seq") / 37))
    got = running(df, ["k"], ["day", "blk"], ["seq"], {"s": ("sum", "v"), "hi": ("max", "v"), "lo": ("min", "v")})
    w = Window.partitionBy("k").orderBy("day", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "seq", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("hi"), F.min("v").over(w).alias("lo"))
    pick = lambda d: sorted(map(tuple, d.select("k", "seq", "s", "hi", "lo").collect()))
    assert pick(got) == pick(want)


def test_dense_index_is_row_number(spark):
    df = rows(spark).withColumn("blk", F.floor(F.col("seq") / 50))
    got = dense_index(df, ["k"], ["blk"], ["seq"])
    w = Window.partitionBy("k").orderBy("seq")
    assert got.join(df.select("seq", (F.row_number().over(w) - 1).alias("want")), "seq").where("idx <> want").count() == 0


def test_top_n_with_salt_matches_plain(spark):
    df = rows(spark)
    order = [F.col("v").desc(), F.col("seq")]
    plain = {tuple(r) for r in top_n_per_key(df, ["k"], order, 5).collect()}
    salted = {tuple(r) for r in top_n_per_key(df, ["k"], order, 5, salt_by=["seq"], salts=4).collect()}
    assert plain == salted and len(plain) == 15


def test_pick_and_totals(spark):
    df = rows(spark)
    last = {r.k: r.seq for r in pick_per_key(df, ["k"], [F.col("seq")]).collect()}
    want = {r.k: r.m for r in df.groupBy("k").agg(F.max("seq").alias("m")).collect()}
    assert last == want
    total = with_totals(df, ["k"], t=F.sum("v")).groupBy("k").agg(F.first("t").alias("t"), F.sum("v").alias("s")).collect()
    assert all(r.t == r.s for r in total)


def test_share_below_counts_strictly_lower(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 9.0), ("b", -3.0)], "g STRING, v DOUBLE")
    got = sorted((r.g, r.v, r.pct_rank) for r in share_below(df, ["g"], "v", blocks=4).collect())
    assert got == [("a", 1.0, 0.0), ("a", 2.0, 25.0), ("a", 2.0, 25.0), ("a", 9.0, 75.0), ("b", -3.0, 0.0)]


def test_ties_of_a_rounded_percent_fall_by_whole_numbers(spark):
    from decimal import ROUND_HALF_UP, Decimal

    n = 12_800  # 512 x 25: every 100 k / n has at most seven digits, half of them ties that a double does not hold
    df = spark.range(n).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    got = {int(r.v): r.pct_rank for r in share_below(df, ["g"], "v", digits=6).collect()}
    want = {k: float((Decimal(100 * k) / n).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for k in range(n)}
    assert got == want


def test_share_below_holds_when_quantiles_differ_each_time(spark, monkeypatch):
    # Approximate quantiles depend on the order in which partial ones arrive; here each evaluation gives others.
    def shaky(value, shares, accuracy):
        return F.array(F.min(value) + (F.max(value) - F.min(value)) * F.expr("cast(reflect('java.lang.Math', 'random') AS DOUBLE)"))

    monkeypatch.setattr(F, "percentile_approx", shaky)
    df = spark.range(2_000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with many groups: a broadcast would be shared by both uses
    try:
        got = {int(r.v): r.pct_rank for r in share_below(df, ["g"], "v", digits=6).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {k: k / 20 for k in range(2_000)}
