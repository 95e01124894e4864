"""Pricing of held names: spans, stretches without a price, and baskets."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelmill.operators import ledger, orders

D0, NAN = date(2025, 1, 6), float("nan")
FILL = "fund string, ticker string, session date, seq bigint, side string, quantity bigint, price double"


def day(i):
    return D0 + timedelta(i)


def given(spark, prices, n=12, fills=(("A", 0, "buy", 10), ("A", 8, "sell", 10))):
    f = spark.createDataFrame([("f", t, day(d), i, s, q, 1.0) for i, (t, d, s, q) in enumerate(fills)], FILL)
    f = f.withColumn("price", F.col("price").cast("decimal(18,5)"))
    p = spark.createDataFrame([("A", day(d), float(c)) for d, c in prices], "ticker string, d date, close double")
    s = spark.createDataFrame([(day(i),) for i in range(n)], "d date")
    return f, p, s


def stretches(df):
    return sorted(((r.first - D0).days, (r["last"] - D0).days, r.n_sessions) for r in df.collect())


@pytest.mark.parametrize("tolerance,want", [(0, [(1, 3, 3), (5, 7, 3)]), (2, [(3, 3, 1), (7, 7, 1)]), (5, []), (None, [])])
def test_stretches_between_prices(spark, tolerance, want):
    f, p, s = given(spark, [(0, 5), (4, 6), (9, 7)])
    assert stretches(ledger.unpriced_stretches(f, p, s, tolerance=tolerance)) == want


def test_names_without_any_price_and_bad_closes(spark):
    f, p, s = given(spark, [(2, NAN), (3, 0), (5, -1)])
    assert stretches(ledger.unpriced_stretches(f, p, s)) == [(0, 7, 8)]
    f, p, s = given(spark, [(1, 5)], fills=(("A", 0, "buy", 5),))
    assert stretches(ledger.unpriced_stretches(f, p, s, tolerance=1)) == [(0, 0, 1), (3, 11, 9)]


def test_stretches_without_a_session_need_no_price(spark):
    f, p, s = given(spark, [(0, 5), (3, 5), (4, 5), (5, 5), (6, 5), (7, 5)])
    weekdays = s.where(~F.col("d").isin(day(1), day(2)))
    assert stretches(ledger.unpriced_stretches(f, p, weekdays)) == []


def test_nav_counts_or_refuses_stale_prices(spark):
    f, p, s = given(spark, [(0, 5), (4, 6)], n=8)
    nav = {(r.session - D0).days: (r.nav, r.n_unpriced) for r in ledger.daily_nav(f, p, s, F.lit(100.0), tolerance=1).collect()}
    assert nav[1] == (140.0, 0) and nav[2] == (90.0, 1) and nav[4] == (150.0, 0) and nav[7] == (90.0, 1)
    with pytest.raises(Exception, match="no usable price"):
        ledger.daily_nav(f, p, s, F.lit(100.0), tolerance=1, require_priced=True).collect()
    assert ledger.daily_nav(f, p, s, F.lit(100.0), require_priced=True).count() == 8


def test_one_bad_mark_fails_its_basket(spark):
    needed = spark.createDataFrame([("x", "A", D0), ("x", "B", D0), ("y", "A", D0), ("y", "C", D0)], "basket string, ticker string, session date")
    bars = spark.createDataFrame([("A", D0, 1.0), ("B", D0, 2.0), ("C", D0, NAN)], "ticker string, d date, close double")
    got = orders.basket_marks(orders.exact_marks(needed, bars), ["basket", "session"]).collect()
    marks = {(r.basket, r.ticker): r.mark for r in got}
    assert marks == {("x", "A"): 1.0, ("x", "B"): 2.0, ("y", "A"): None, ("y", "C"): None}
    assert {r.basket_reason for r in got if r.basket == "y"} == {"close must be finite and positive"}
    assert {r.n_unusable for r in got if r.basket == "x"} == {0}
