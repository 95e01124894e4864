"""Blend, sleeve, clamp and order tables with numbers worked by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from panelmill.operators import checks, orders, portfolio, risk

DAY = date(2025, 1, 3)


def blend(spark, votes, models, mode="long_short", gross=1.0):
    """votes: (model, ticker, value or None for an abstention); models: name -> (weight, approach)."""
    s = spark.createDataFrame(
        [(m, t, DAY, 0.0 if v is None else float(v), v is None) for m, t, v in votes],
        "model_name STRING, ticker STRING, date DATE, value DOUBLE, abstained BOOLEAN")
    m = spark.createDataFrame([("s", n, float(w), a) for n, (w, a) in models.items()],
                              "strategy STRING, model_name STRING, weight DOUBLE, approach STRING")
    st = spark.createDataFrame([("f", "s", 1.0, mode, gross)], "fund STRING, strategy STRING, weight DOUBLE, mode STRING, gross_target DOUBLE")
    return {r.ticker: r for r in portfolio.sleeve_weights(portfolio.blend_convictions(portfolio.staff(s, m, st))).collect()}


PAIR = {"owner": (1, "long_only"), "trader": (1, "long_short")}


@pytest.mark.parametrize("owner,trader,score", [(0.8, -0.6, 0.1), (-0.8, 0.6, 0.0), (-0.8, -0.6, -0.3), (-0.8, 0.0, 0.0)])
def test_permission_to_short(spark, owner, trader, score):
    got = blend(spark, [("owner", "A", owner), ("trader", "A", trader)], PAIR)
    assert got["A"].score == pytest.approx(score)


def test_neutral_votes_dilute_and_abstentions_do_not(spark):
    heavy = {"owner": (3, "long_only"), "trader": (1, "long_short")}
    votes = [("owner", "N", 0), ("trader", "N", -0.6), ("owner", "X", None), ("trader", "X", -0.6),
             ("owner", "Z", None), ("trader", "Z", None)]
    got = blend(spark, votes, heavy)
    assert got["N"].score == pytest.approx(-0.15) and got["X"].score == pytest.approx(-0.6) and got["Z"].score == 0
    for bearish in (-1, -0.5, 0):
        got = blend(spark, [("owner", "A", bearish), ("trader", "A", -0.6)], heavy)
        assert got["A"].score == pytest.approx(-0.15)


def test_dollar_neutral(spark):
    one = {"m": (1, "long_short")}
    got = blend(spark, [("m", "A", 1), ("m", "B", -0.1), ("m", "C", -0.3)], one, "dollar_neutral", 1.6)
    assert [got[t].weight for t in "ABC"] == pytest.approx([0.8, -0.2, -0.6])
    got = blend(spark, [("m", "A", 0.8), ("m", "B", 0.2)], one, "dollar_neutral")
    assert {r.flat_reason for r in got.values()} == {"missing_short_side"} and all(r.weight == 0 for r in got.values())
    got = blend(spark, [("m", "A", 1e-10), ("m", "B", -1e-10)], one, "dollar_neutral")
    assert {r.flat_reason for r in got.values()} == {"no_eligible_positions"}


def book(spark, weights):
    return spark.createDataFrame([("f", DAY, t, float(w)) for t, w in weights.items()], "fund STRING, date DATE, ticker STRING, netted DOUBLE")


def caps(spark, position, gross):
    return spark.createDataFrame([("f", 1.0, position, gross)], "fund STRING, capital DOUBLE, max_position_pct DOUBLE, max_gross_exposure DOUBLE")


def test_clamp_then_gross(spark):
    funds = caps(spark, 0.25, 1.0)
    got = risk.clamp_positions(book(spark, {c: 0.5 for c in "ABCDEF"}), funds)
    assert sum(abs(r.final) for r in got.collect()) == pytest.approx(1.0)
    fired = [r.limit for r in risk.clamp_audit(got).collect()]
    assert fired.count("max_position_pct") == 6 and fired.count("max_gross_exposure") == 1
    got = {r.ticker: r.final for r in risk.clamp_positions(book(spark, {"A": 0.9, "B": 0.05, "C": -0.4}), funds).collect()}
    assert got == {"A": 0.25, "B": 0.05, "C": -0.25}


def test_common_factor(spark):
    w = {"A": 0.5, "B": -0.25, "C": -0.25}
    got = {r.ticker: r for r in risk.scale_proportional(book(spark, w), caps(spark, 0.25, 1.0)).collect()}
    assert got["A"].factor == pytest.approx(0.5) and got["B"].final == pytest.approx(-0.125)
    got = risk.scale_proportional(book(spark, w), caps(spark, 0.25, 0.3))
    rows = {r.ticker: r for r in got.collect()}
    assert [rows[t].final for t in "ABC"] == pytest.approx([0.15, -0.075, -0.075]) and rows["A"].factor == pytest.approx(0.3)
    audit = {(r.limit, r.ticker): r.after for r in risk.clamp_audit(got).collect()}
    assert audit[("max_position_pct", "A")] == pytest.approx(0.25)  # before the gross factor
    both = spark.createDataFrame([("f", True)], "fund STRING, proportional BOOLEAN")
    same = {r.ticker: r.final for r in risk.apply_limits(book(spark, w), caps(spark, 0.25, 0.3), both).collect()}
    assert same == pytest.approx({t: rows[t].final for t in "ABC"})


SLEEVE = "fund STRING, strategy STRING, date DATE, ticker STRING, weight DOUBLE"


def contributions(spark, sleeves, slices, position, gross, neutral):
    s = spark.createDataFrame([("f", st, DAY, t, float(w)) for st, t, w in sleeves], SLEEVE)
    st = spark.createDataFrame([("f", n, float(w), "m", 1.0) for n, w in slices.items()],
                               "fund STRING, strategy STRING, weight DOUBLE, mode STRING, gross_target DOUBLE")
    shares = portfolio.strategy_slices(st)
    flag = spark.createDataFrame([("f", neutral)], "fund STRING, proportional BOOLEAN")
    risked = risk.apply_limits(portfolio.net_sleeves(s, shares), caps(spark, position, gross), flag)
    parts = {(r.strategy, r.ticker): r.contribution for r in portfolio.final_contributions(s, shares, risked).collect()}
    return {r.ticker: r for r in risked.collect()}, parts


def test_attribution_of_a_scaled_book(spark):
    risked, parts = contributions(spark, [("neutral", "A", 0.5), ("neutral", "B", -0.5), ("owner", "A", 1)],
                                  {"neutral": 3, "owner": 1}, 0.25, 1.0, True)
    assert risked["A"].netted == pytest.approx(0.625) and risked["B"].netted == pytest.approx(-0.375)
    assert risked["A"].factor == pytest.approx(0.4)
    assert parts == pytest.approx({("neutral", "A"): 0.15, ("neutral", "B"): -0.15, ("owner", "A"): 0.1})


def test_offsetting_legs_stay_visible(spark):
    risked, parts = contributions(spark, [("x", "A", 0.5), ("y", "A", -0.5), ("x", "B", 0.5), ("y", "B", 0.5)],
                                  {"x": 1, "y": 1}, 0.2, 1.0, False)
    assert risked["A"].final == 0 and risked["B"].final == pytest.approx(0.2)
    assert parts == pytest.approx({("x", "A"): 0.25, ("y", "A"): -0.25, ("x", "B"): 0.1, ("y", "B"): 0.1})


def test_modes_models_and_bad_input(spark):
    m = spark.createDataFrame([("s", "a", 1.0, "long_only"), ("t", "b", -1.0, "long_short"), ("t", "c", 1.0, "sideways")],
                              "strategy STRING, model_name STRING, weight DOUBLE, approach STRING")
    got = {r.strategy: (r.mode, r.kind) for r in portfolio.strategy_modes(m, F.col("model_name") == "a").collect()}
    assert got == {"s": ("long_only", "discretionary"), "t": ("long_short", "systematic")}
    s = spark.createDataFrame([("a", "A", DAY, float("nan"), False), ("a", "B", DAY, 1.1, False), ("z", "A", DAY, 0.5, False),
                               ("a", "C", DAY, 1.0, False)], "model_name STRING, ticker STRING, date DATE, value DOUBLE, abstained BOOLEAN")
    st = spark.createDataFrame([("f", "s", 1.0, "odd", float("inf"))], "fund STRING, strategy STRING, weight DOUBLE, mode STRING, gross_target DOUBLE")
    found = sorted((r.rule, r.subject) for r in portfolio.input_violations(s, m, st).collect())
    assert [x for x in found if x[0].startswith("signal")] == [
        ("signal must be finite and within [-1, 1]", f"a:A:{DAY}"), ("signal must be finite and within [-1, 1]", f"a:B:{DAY}")]
    assert {x[0] for x in found} >= {"mode is unknown", "gross target must be finite and positive", "model has no vote weight",
                                     "vote weight must be finite and positive", "approach must be long_only or long_short"}


def test_orders_sells_first_and_truncates(spark):
    df = spark.createDataFrame(
        [("f", DAY, "A", 0.5, 0, 300.0, 10_000.0), ("f", DAY, "B", -0.5, 0, 700.0, 10_000.0),
         ("f", DAY, "C", 0.0, 7, 10.0, 10_000.0), ("f", DAY, "D", 0.0299, 2, 100.0, 10_000.0),
         ("f", DAY, "E", -1.0, 50, 100.0, 7_500.0)],
        "fund STRING, session DATE, ticker STRING, weight DOUBLE, shares BIGINT, mark DOUBLE, equity DOUBLE")
    got = orders.order_sequence(orders.delta_orders(df)).orderBy("seq").collect()
    assert [(r.seq, r.ticker, r.side, r.quantity) for r in got] == [
        (1, "B", "sell", 7), (2, "C", "sell", 7), (3, "E", "sell", 125), (4, "A", "buy", 16)]
    broken = orders.projected_violations(df, orders.delta_orders(df), caps(spark, 0.5, 1.0)).collect()
    assert sorted((r.limit, r.ticker) for r in broken) == [("max_gross_exposure", None), ("max_position_pct", "E")]


def test_exact_marks_and_tradeable(spark):
    bars = spark.createDataFrame([("A", DAY, 10.0), ("B", DAY, 0.0)], "ticker STRING, d DATE, close DOUBLE")
    need = spark.createDataFrame([(t, DAY) for t in "ABC"], "ticker STRING, session DATE")
    got = {r.ticker: r.reason for r in orders.exact_marks(need, bars).collect()}
    assert got == {"A": None, "B": "close must be finite and positive", "C": "missing close"}
    kept, skipped = orders.split_tradeable(need.withColumnRenamed("session", "as_of"), bars.select("ticker", F.col("d").alias("as_of")))
    assert kept.count() == 2 and [r.reason for r in skipped.collect()] == [f"no close within 7 days of {DAY}"]


def test_execution_uses_the_day_before(spark):
    friday, monday = date(2025, 1, 3), date(2025, 1, 6)
    due = spark.createDataFrame([("f", monday)], "fund STRING, execution_date DATE")
    assessed = spark.createDataFrame([("f", friday, "A", 0.1), ("f", date(2025, 1, 5), "A", 0.2)],
                                     "fund STRING, date DATE, ticker STRING, final DOUBLE")
    got = orders.execution_views(due, assessed).collect()
    assert [(r.date, r.final) for r in got] == [(date(2025, 1, 5), 0.2)]


def test_require_stops_the_job_and_sets_compare(spark):
    df = spark.range(3).withColumn("v", F.col("id").cast("double"))
    assert checks.require(df, {"not negative": F.col("v") >= 0}).count() == 3
    with pytest.raises(Exception, match="below two"):
        checks.require(df, {"below two": F.col("v") < 2}).collect()
    assert checks.set_difference(df.select("id"), spark.range(1, 4)).count() == 2
    assert [r.rule for r in checks.violations(df, {"small": F.col("v") < 1}, ["id"]).collect()] == ["small", "small"]


def test_the_assessed_panel_reaches_the_last_day_of_signals(spark):
    from panelmill.plans import registry

    folder = "/root/testdata/sf0.001"
    last = spark.read.parquet(f"{folder}/events.parquet").selectExpr("max(CAST(ts AS DATE))").first()[0]
    assert registry.queries()["assess_panel"](spark, folder).selectExpr("max(date)").first()[0] == last
    assert "DATE '2024-01-20'" not in registry.oracle_sql()["assess_panel"]
