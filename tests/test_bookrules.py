"""One planted error for each rule, and assessments of a whole panel."""

from datetime import date, timedelta

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from panelmill.operators import bookrules, portfolio, risk

DAY, NAN, INF = date(2025, 1, 3), float("nan"), float("inf")
KEYS = "fund string, strategy string, date date, ticker string"
STRATEGIES = "fund string, strategy string, weight double, mode string, gross_target double"
FUNDS = "fund string, max_position_pct double, max_gross_exposure double"
# A sound book: (strategy, ticker, score, weight, slice, contribution); final weights are their sums.
BOOK = [("own", "A", 0.5, 0.5, 0.5, 0.25), ("own", "B", 0.5, 0.5, 0.5, 0.25), ("hedge", "A", 0.4, 0.4, 0.5, 0.2), ("hedge", "B", -0.4, -0.4, 0.5, -0.2)]
MANDATE = [("f", "own", 1.0, "long_only", 1.0), ("f", "hedge", 1.0, "dollar_neutral", 0.8)]


def found(spark, book=BOOK, evidence=None, finals=None, mandate=MANDATE, funds=(("f", 0.6, 1.0),), flat=None):
    r = [("f", s, DAY, t, float(sc), float(w), float(sl)) for s, t, sc, w, sl, _ in book]
    records = spark.createDataFrame(r, f"{KEYS}, score double, weight double, slice double")
    e = evidence if evidence is not None else BOOK
    proof = spark.createDataFrame([("f", s, DAY, t, float(sc), flat) for s, t, sc, *_ in e], f"{KEYS}, score double, flat_reason string")
    parts = spark.createDataFrame([("f", s, DAY, t, float(c)) for s, t, *_, c in book], f"{KEYS}, contribution double")
    f = finals if finals is not None else {"A": 0.45, "B": 0.05}
    last = spark.createDataFrame([("f", DAY, t, float(w)) for t, w in f.items()], "fund string, date date, ticker string, final double")
    terms = spark.createDataFrame(mandate, STRATEGIES)
    limits = spark.createDataFrame(list(funds), FUNDS)
    return {(x.rule, x.strategy, x.ticker) for x in bookrules.broken_rules(records, parts, last, proof, terms, limits).collect()}


def changed(at, **values):
    names = ("strategy", "ticker", "score", "weight", "slice", "contribution")
    row = dict(zip(names, BOOK[at], strict=True)) | values
    return [tuple(row.values()) if i == at else b for i, b in enumerate(BOOK)]


def test_a_sound_book_breaks_no_rule(spark):
    assert found(spark) == set()


@pytest.mark.parametrize("given,rule", [
    ({"book": changed(0, score=0.6)}, ("score does not match evidence", "own", "A")),
    ({"book": changed(0, score=NAN)}, ("score not finite", "own", "A")),
    ({"evidence": BOOK[1:]}, ("score without evidence", "own", "A")),
    ({"evidence": [*BOOK, ("own", "C", 0.1, 0, 0, 0)]}, ("evidence without score", "own", "C")),
    ({"book": changed(0, weight=NAN)}, ("target not finite", "own", "A")),
    ({"book": changed(0, weight=INF)}, ("target gross not finite", "own", None)),
    ({"book": changed(0, weight=-0.2)}, ("long-only target negative", "own", "A")),
    ({"book": changed(2, weight=-0.4)}, ("negative target without short evidence", "hedge", "A")),
    ({"book": changed(0, weight=0.7)}, ("target exceeds gross target", "own", None)),
    ({"book": changed(2, weight=0.3)}, ("target not dollar-neutral", "hedge", None)),
    ({"book": changed(0, contribution=0.4)}, ("contribution exceeds gross target", "own", None)),
    ({"book": changed(3, contribution=-0.1)}, ("contribution not dollar-neutral", "hedge", None)),
    ({"book": changed(0, contribution=NAN)}, ("final weight or contribution not finite", None, "A")),
    ({"book": changed(0, slice=0.51)}, ("slice does not match the mandate", "own", None)),
    ({"book": changed(0, slice=NAN)}, ("slice does not match the mandate", "own", None)),
    ({"book": [*BOOK, ("ghost", "A", 0.1, 0.1, 0.5, 0.0)]}, ("strategy outside the mandate", "ghost", None)),
    ({"book": BOOK[:2]}, ("strategy has no record", "hedge", None)),
    ({"flat": "missing_long_side"}, ("flat strategy with target", "own", "A")),
    ({"finals": {"A": 0.45, "B": 0.06}}, ("contributions do not sum to final", None, "B")),
    ({"finals": {"A": 0.45, "B": 0.05, "C": 0.7}}, ("final exceeds position cap", None, "C")),
    ({"finals": {"A": 0.6, "B": 0.5}}, ("final exceeds gross cap", None, None)),
    ({"finals": {"A": INF, "B": 0.05}}, ("final gross not finite", None, None)),
    ({"funds": (("other", 0.6, 1.0),)}, ("fund has no limits", None, None)),
    ({"mandate": [*MANDATE, ("idle", "own", 0.0, "long_only", 1.0)]}, ("allocations need a finite, positive total", None, None)),
])
def test_each_rule_finds_its_error(spark, given, rule):
    assert rule in found(spark, **given)


def test_every_rule_is_planted(spark):
    """Targets and contributions share their rules; the rule on strategies outside the mandate has a test of its own."""
    planted = {p[1][0].replace("contribution", "target") for p in test_each_rule_finds_its_error.pytestmark[0].args[1]}
    named = {r.name.replace("contribution", "target") for r in bookrules.rules()}
    assert named - planted == {"target of a strategy outside the mandate"}


def panel(spark, days=2):
    dates = [DAY + timedelta(i) for i in range(days)]
    signals = spark.createDataFrame(
        [(m, t, d, v, False) for d in dates for m, t, v in (("m", "A", 0.9), ("m", "B", 0.3), ("m", "C", -0.5), ("m", "X", 1.0))],
        "model_name string, ticker string, date date, value double, abstained boolean")
    marks = spark.createDataFrame([(t, DAY - timedelta(1), c) for t, c in (("A", 10.0), ("B", 20.0), ("C", 5.0), ("X", 0.0))], "ticker string, d date, close double")
    models = spark.createDataFrame([("s", "m", 1.0, "long_short")], "strategy string, model_name string, weight double, approach string")
    mandate = spark.createDataFrame([("f", "s", 1.0, "long_short", 1.0)], STRATEGIES)
    funds = spark.createDataFrame([("f", 0.25, 0.5)], FUNDS)
    return signals, marks, models, mandate, funds


def test_assessment_of_a_panel(spark):
    now = F.to_timestamp(F.lit("2025-01-06 03:00:00"))  # still January 5 in New York
    seen = Observation()
    done = portfolio.assess(*panel(spark), now=now, observation=seen)
    report = done.report().collect()
    assert len(report) == 2 and {r.n_skipped for r in report} == {1} and {r.n_violations for r in report} == {0}
    assert {(r.n_names, r.n_position_clamps, r.n_gross_clamps) for r in report} == {(3, 2, 1)}
    assert all(r.gross_final == pytest.approx(0.5) for r in report)
    assert {(r.ticker, r.reason) for r in done.skipped.collect()} == {("X", "no usable close within 7 days")}
    assert seen.get == {"n_names": 6, "n_over_cap": 4, "n_not_finite": 0, "n_broken_cap": 0}
    assert done.contributions.count() == 6 and done.violations.count() == 0


def test_an_incomplete_day_stops_the_assessment(spark):
    with pytest.raises(Exception, match="not complete"):
        portfolio.assess(*panel(spark), now=F.to_timestamp(F.lit("2025-01-05 03:00:00")))


def test_limits_beyond_the_whole_book_and_endless_gross(spark):
    book = spark.createDataFrame([("f", DAY, "A", 1e308), ("f", DAY, "B", 1e308)], "fund string, date date, ticker string, netted double")
    for fn in (risk.clamp_positions, risk.scale_proportional):
        with pytest.raises(Exception, match="at most 1"):
            fn(book, spark.createDataFrame([("f", 1.5, 1.0)], FUNDS)).collect()
    with pytest.raises(Exception, match="gross exposure must be finite"):
        risk.scale_proportional(book, spark.createDataFrame([("f", 0.5, 1.0)], FUNDS)).collect()


def test_sums_stay_in_hash_aggregation(spark):
    # Text among the sums would sort every group, and the sort holds a task's rows.
    records = spark.createDataFrame([("f", "a", date(2026, 1, 5), "X", 1.0, 1.0, 1.0, None)], "fund string, strategy string, date date, ticker string, score double, weight double, slice double, flat_reason string")
    parts = records.select("fund", "strategy", "date", "ticker", F.col("weight").alias("contribution"))
    finals = records.select("fund", "date", "ticker", F.col("weight").alias("final"))
    mandate = records.select("fund", "strategy", F.lit("long_only").alias("mode"), F.lit(1.0).alias("gross_target"), F.lit(1.0).alias("share"))
    found = bookrules.levels(records, parts, finals, records, mandate)
    assert set(found) == set(bookrules.LEVELS)
    for level, sums in found.items():
        held = sums.drop("mode")._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in held, level
        assert sums.count() == 1
