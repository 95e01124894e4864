import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from panelmill.operators import asof

D0 = date(2024, 1, 1)


def day(n):
    return D0 + timedelta(days=n)


def quotes(spark, seed, n=40):
    rng = random.Random(seed)
    data = sorted({(rng.choice("AB"), rng.randrange(120)) for _ in range(n)})
    return data, spark.createDataFrame([(k, day(d), float(d)) for k, d in data], "ticker STRING, d DATE, close DOUBLE")


def test_backward_with_tolerance(spark):
    data, df = quotes(spark, 1)
    asks = [(k, n) for k in "AB" for n in range(0, 130, 3)]
    req = spark.createDataFrame([(k, day(n)) for k, n in asks], "ticker STRING, as_of DATE")
    got = {(r.ticker, (r.as_of - D0).days): r.close for r in asof.asof_backward(req, df, ["ticker"], "d", tolerance=7).collect()}
    for k, n in asks:
        known = [d for kk, d in data if kk == k and n - 7 <= d <= n]
        assert got[(k, n)] == (float(max(known)) if known else None)


def test_forward_snap(spark):
    data, df = quotes(spark, 2)
    asks = [(i, "AB"[i % 2], i) for i in range(120)]
    req = spark.createDataFrame([(i, k, day(n)) for i, k, n in asks], "id INT, ticker STRING, f DATE")
    got = {r.id: r.close for r in asof.snap_forward(req, df, ["ticker"], "d", "f", tolerance=4).collect()}
    for i, k, n in asks:
        later = [d for kk, d in data if kk == k and n <= d <= n + 4]
        assert got.get(i) == (float(min(later)) if later else None)


def test_overlap_join_finds_each_pair_once(spark):
    rng = random.Random(3)
    spans = lambda n: [(i, rng.randrange(200), rng.randrange(60)) for i in range(n)]
    a, b = spans(30), spans(30)
    left = spark.createDataFrame([(i, "x", day(s), day(s + n)) for i, s, n in a], "li INT, k STRING, lf DATE, lt DATE")
    right = spark.createDataFrame([(i, "x", day(s), day(s + n)) for i, s, n in b], "ri INT, k STRING, rf DATE, rt DATE")
    got = sorted((r.li, r.ri, r.seg_start, r.seg_end) for r in asof.overlap_join(left, right, ["k"], ("lf", "lt"), ("rf", "rt")).collect())
    want = sorted(
        (i, j, day(max(s, u)), day(min(s + n, u + m)))
        for i, s, n in a for j, u, m in b if max(s, u) <= min(s + n, u + m)
    )
    assert got == want


def test_newest_known_matches_brute_force(spark):
    rng = random.Random(4)
    facts = [(i, rng.choice("AAAB"), rng.randrange(300)) for i in range(90)]
    grid = [(k, n) for k in "AB" for n in range(0, 320, 11)]
    f = spark.createDataFrame([(i, k, day(d)) for i, k, d in facts], "id INT, ticker STRING, filed DATE")
    g = spark.createDataFrame([(k, day(n)) for k, n in grid], "ticker STRING, as_of DATE")
    got = sorted((r.ticker, (r.as_of - D0).days, r.rank, r.id) for r in asof.newest_known(g, f, ["ticker"], "filed", ["id"], n=4).collect())
    want = []
    for k, n in grid:
        known = sorted(((d, i) for i, kk, d in facts if kk == k and d <= n), reverse=True)[:4]
        want += [(k, n, r + 1, i) for r, (_, i) in enumerate(known)]
    assert got == sorted(want)


def test_spans_on_dates(spark):
    spans = spark.createDataFrame([("a", day(0), day(9)), ("b", day(5), day(6))], "k STRING, f DATE, t DATE")
    dates = spark.createDataFrame([(day(n),) for n in (0, 6, 9, 20)], "d DATE")
    got = sorted((r.k, (r.s - D0).days) for r in asof.spans_on_dates(spans, dates, "d", "f", "t", "s").collect())
    assert got == [("a", 0), ("a", 6), ("a", 9), ("b", 6)]
    cells = asof.on_dates(spans.select("k"), dates.where(F.col("d") <= day(6)), "d")
    assert cells.count() == 4


def test_newest_lists_unfold_no_fact_and_match_brute_force(spark):
    rng = random.Random(12)
    facts = [(f"k{rng.randrange(3)}", D0 + timedelta(days=rng.randrange(40)), i) for i in range(120)] + [("k0", None, 900), (None, D0, 901)]
    grid = [(k, D0 + timedelta(days=d), d) for k in ("k0", "k1", "k9") for d in (-1, 0, 7, 7 + 30, 90)] + [(None, D0, 0)]
    f = spark.createDataFrame(facts, "ticker STRING, filed DATE, id BIGINT")
    g = spark.createDataFrame(grid, "ticker STRING, as_of DATE, tag INT")
    found = asof.newest_lists(g, f, ["ticker"], "filed", ["id"], n=4)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.ticker, r.as_of, r.tag): [p.id for p in r.known] for r in found.where("ticker IS NOT NULL").collect()}
    for k, day, tag in grid[:-1]:
        known = sorted(((d, i) for t, d, i in facts if t == k and d is not None and d <= day), reverse=True)
        assert got[k, day, tag] == [i for _, i in known[:4]]
    assert len(got) == len(grid) - 1
    assert [r.known for r in found.where("ticker IS NULL").collect()] == [[]]


def test_carried_to_listed_dates_only(spark):
    quotes = spark.createDataFrame(
        [(k, date(2024, 1, 1) + timedelta(days=d), float(d)) for k in "AB" for d in (0, 3, 4, 20, 31, 33)], "ticker string, d date, close double")
    dates = spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=d),) for d in (2, 2, 4, 11, 12, 31, 40)], "session date")
    listed = asof.carry_forward(quotes, ["ticker"], "d", tolerance=7, as_of="session", dates=dates)
    full = asof.carry_forward(quotes, ["ticker"], "d", tolerance=7, as_of="session").join(dates.distinct(), "session", "left_semi")
    rows = lambda df: sorted(tuple(r) for r in df.select("ticker", "session", "d", "close").collect())
    assert rows(listed) == rows(full) and len(rows(listed)) == 10


def test_suppliers_unfold_in_many_tasks(spark):
    from panelmill.plans import q_portfolio
    from panelmill.plans.datasets import Dataset

    assert q_portfolio.targets(Dataset(spark, "/root/testdata/sf0.001")).rdd.getNumPartitions() > 8
