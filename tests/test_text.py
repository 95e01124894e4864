import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelmill.functions import answers, scalar, text
from panelmill.operators import snapshot
from panelmill.sources import reads, receipts


def column(spark, values, kind="STRING"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}").repartition(2)


def apply(spark, values, fn, kind="STRING"):
    return [r.o for r in column(spark, values, kind).select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_extract_json(spark):
    cases = ['```json\n{"a": 1}\n```', 'text {"a": {"b": 2}} tail {"c": 3}', ' {"a": 1} ', "no json", "{broken", '{"a": 1',
             '```\n{"a": {"b": 1}}\n```', "set {x} then"]
    got = apply(spark, cases, answers.extract_json_answer)
    assert [json.loads(g) if g else None for g in got] == [
        {"a": 1}, {"a": {"b": 2}}, {"a": 1}, None, None, None, {"a": {"b": 1}}, None]


def test_validate_answers(spark):
    cases = ['{"signal": "Bullish", "confidence": 80, "reasoning": "r"}', '{"signal": "bearish"}', '{"signal": "up", "confidence": 5}',
             '{"signal": "neutral", "confidence": 101}', '{"signal": "bearish", "confidence": null}', "[1]", "garbage",
             '{"signal": "bearish", "confidence": "25"}']
    rows = answers.validate_answers(column(spark, cases).withColumnRenamed("v", "text")).orderBy("i").collect()
    assert [r.value for r in rows] == [0.8, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -0.25]
    assert [r.abstained for r in rows] == [False, False, True, True, True, True, True, False]
    assert rows[2].abstain_reason == "invalid signal" and rows[0].reasoning == "r" and rows[1].confidence == 0.0


def typed(direction="bullish", score=3, **change):
    scores = {str(i): 0.2 for i in range(5)}
    body = {"answers": {
        "direction": {"type": "choice", "choice": direction, "confidence": 0.5,
                      "probabilities": {"bullish": 0.5, "bearish": 0.25, "neutral": 0.25}},
        "bullish_strength": {"type": "score", "score": score, "confidence": 1, "probabilities": scores},
        "bearish_strength": {"type": "score", "score": 1, "confidence": 1, "probabilities": scores}}}
    for path, value in change.items():
        part, field = path.split("__")
        body["answers"][part][field] = value
    return json.dumps(body)


def test_typed_answers(spark):
    cases = [typed(), typed("neutral"), typed("bearish"), typed(bullish_strength__score=5), typed(direction__choice="up"),
             typed(direction__probabilities={"bullish": 1.0}), typed(direction__confidence="0.5"), "{}", typed(score=0)]
    rows = answers.normalize_typed_answers(column(spark, cases).withColumnRenamed("v", "body")).orderBy("i").collect()
    assert [r.confidence for r in rows] == [75.0, 0.0, 25.0, None, None, None, None, None, 0.0]
    assert rows[3].error == "bullish_strength.score out of range" and rows[7].error == "answers must be an object"
    assert rows[8].signal == "bullish" and rows[8].error is None


def test_salvage(spark):
    cases = ['{"signal": "Bullish", "confidence": 7', '{"signal": "bearish", "confidence": 78, "reasoning": "a\\nb \\"q\\" \\u00e9 x',
             '{"signal": "bea', '{"reasoning": "tail\\', '{"reasoning": "cut \\u00', '{"reasoning": "done", "x": 1}']
    rows = answers.salvage_partial(column(spark, cases).withColumnRenamed("v", "text")).orderBy("i").collect()
    assert [(r.signal, r.confidence, r.thesis) for r in rows] == [
        ("bullish", None, ""), ("bearish", 78.0, 'a\nb "q" é x'), (None, None, ""), (None, None, "tail"),
        (None, None, "cut "), (None, None, "done")]
    said = spark.createDataFrame([("bullish", 78.4), ("bearish", None), (None, None)], "s STRING, c DOUBLE")
    assert [r.v for r in said.select(answers.verdict_so_far(F.col("s"), F.col("c")).alias("v")).collect()] == ["BULLISH 78%", "BEARISH", None]


def test_number_text_matches_python(spark):
    values = [0.125, 0.135, 2.675, -0.005, 1234.5, 1e6, 1.25e9, 999999.995, None, -3.5e7]
    want = ["-" if v is None else f"{v / 1e9:.1f}B" if abs(v) >= 1e9 else f"{v / 1e6:.1f}M" if abs(v) >= 1e6 else f"{v:.2f}" for v in values]
    assert apply(spark, values, text.humanize_number, "DOUBLE") == want
    money = [9999.5, 10_000.0, 10_500.0, 1_234_567.0, -25_000.0, 2.5]
    assert apply(spark, money, text.money_label, "DOUBLE") == [f"${v / 1000:,.0f}k" if abs(v) >= 10_000 else f"${v:,.0f}" for v in money]
    ties = [0.00015, 0.12345, 2.00015, -1.5, 0.03125]
    assert apply(spark, ties, lambda c: scalar.round_exact(c, 4), "DOUBLE") == [round(v, 4) for v in ties]


def test_small_scalars(spark):
    assert apply(spark, ["1.5", "x", None, "NaN", "inf", " 2 "], scalar.safe_float) == [1.5, 0.0, 0.0, 0.0, 0.0, 2.0]
    assert apply(spark, [-3.0, 0.2, 7.0], scalar.clamp, "DOUBLE") == [-1.0, 0.2, 1.0]
    assert apply(spark, [["A"], ["A", "B"], ["A", "B", "C", "D"], []], text.short_list_label, "ARRAY<STRING>") == ["A", "A B", "A B +2", "—"]
    assert apply(spark, ["deep-value", "pead"], lambda c: text.title_from_slug(F.lit(None).cast("string"), c)) == ["Deep Value", "Pead"]
    assert apply(spark, ["key abc and abc"], lambda c: text.redact(c, "abc")) == ["key [REDACTED] and [REDACTED]"]
    blocks = json.dumps([{"type": "thinking", "text": "no"}, {"type": "text", "text": "a"}, "b", {"type": "text"}])
    assert apply(spark, ["plain", blocks, None, '"quoted"'], text.flatten_blocks) == ["plain", "a\nb\n", "", "quoted"]
    assert apply(spark, ["2025-08-01T10:00:00Z"], scalar.day_of) == [date(2025, 8, 1)]


def quarters(spark, n=8, roe=0.2):
    rows = []
    for i in range(n):
        y, q = 2023 + i // 4, i % 4
        period = date(y, 3 * q + 3, 30)
        rows.append((i, "T", period, date(y + (q == 3), (3 * q + 3) % 12 + 1, 15), "ttm", 1e9 + i, roe, 0.25,
                     0.30 + 0.1 * i / (n - 1) if n > 1 else 0.3, 8 * (10 / 8) ** (i / (n - 1)) if n > 1 else 8.0, 0.5))
    return spark.createDataFrame(rows, "filing_id BIGINT, ticker STRING, report_period DATE, filing_date DATE, period STRING, "
                                 "market_cap DOUBLE, return_on_equity DOUBLE, net_margin DOUBLE, gross_margin DOUBLE, "
                                 "book_value_per_share DOUBLE, debt_to_equity DOUBLE")


def test_snapshot_and_prompt(spark):
    facts = spark.createDataFrame([("T", "Tech", "Chips")], "ticker STRING, sector STRING, industry STRING")
    grid = spark.createDataFrame([("T", date(2025, 3, 1)), ("T", date(2025, 4, 1)), ("T", date(2023, 8, 1))], "ticker STRING, as_of DATE")
    snaps = snapshot.fundamentals_snapshot(grid, quarters(spark), facts, with_periods=True)
    rows = snaps.collect()
    assert len(rows) == 2  # the third date knows fewer than four periods
    full = rows[0]
    assert full.n_periods == 8 and full.gross_margin_trend == pytest.approx(0.1) and full.roe_avg == 0.2
    assert full.bvps_cagr == round((10 / 8) ** (1 / 1.75) - 1, 4)
    prompts = [r.prompt for r in snapshot.render_snapshot(snaps).collect()]
    assert len(set(prompts)) == 1 and "2025-03-01" not in prompts[0]  # the same facts give the same text on any date
    blind = snapshot.render_snapshot(snaps, blind=True).collect()[0].prompt
    assert "Company: (withheld)  |  Sector: Tech\n" in blind and "Chips" not in blind and "2024-" not in blind and "t-7 | 1.0B" in blind
    keys = snaps.select(text.row_key(["ticker", "sector", "periods", "roe_avg"]).alias("k")).distinct()
    assert keys.count() == 1 and len(keys.first().k) == 24
    assert snapshot.gate_periods(grid, snapshot.known_periods(grid, quarters(spark))).where("reason IS NOT NULL").count() == 1


def test_growth_guards(spark):
    p = spark.createDataFrame([("T", date(2025, 1, 1), r, v) for r, v in ((1, 10.0), (2, None), (3, 9.0), (4, 8.0))],
                              "ticker STRING, as_of DATE, rank INT, book_value_per_share DOUBLE")
    for c in ("return_on_equity", "net_margin", "gross_margin", "debt_to_equity", "market_cap"):
        p = p.withColumn(c, F.lit(None).cast("double"))
    row = snapshot.snapshot_aggregates(p).first()
    assert row.bvps_cagr == round((10 / 8) ** (1 / 0.5) - 1, 4) and row.roe_avg is None and row.gross_margin_trend is None
    negative = p.withColumn("book_value_per_share", F.when(F.col("rank") == 4, -1.0).otherwise(F.col("book_value_per_share")))
    assert snapshot.snapshot_aggregates(negative).first().bvps_cagr is None


def test_receipts_round_trip(spark, tmp_path):
    docs = [("a", '{"universe": ["A"], "as_of": "2025-01-02", "nav": 5.0, "orders": [{"x": 1}]}'),
            ("a", '{"metrics": {"total_return_pct": 0.1, "excess_return_pct": 0.02, "annualized_return_pct": 0.1, "sharpe_ratio": 1, "max_drawdown_pct": 0, "benchmark_return_pct": 0.08, "n_cycles": 3}, "start": "2025-01-01", "universe": ["B"]}'),
            ("a", '{"status": "pending", "as_of": "2025-01-03", "reason": "r", "proposal": {"universe": ["C"]}}'),
            ("a", '{"universe": ["A"], "nav'), ("a", "[1, 2]"), ("a", '{"universe": ["Z"]}')]
    folder = tmp_path / "runs"
    folder.mkdir()
    for i, (_, body) in enumerate(docs):
        (folder / f"a-run-{i}.json").write_text(body)
    found = receipts.summarize_receipts(receipts.read_receipts(spark, str(folder)))
    assert sorted(r.kind for r in found.collect()) == ["backtest", "pending", "run"]
    refused = receipts.quarantined_receipts(receipts.read_receipts(spark, str(folder))).collect()
    assert sorted((r.fault, r.path[-6]) for r in refused) == [("not a JSON object", "3"), ("not a JSON object", "4"), ("run lacks a field it needs", "5")]
    scored = found.where("kind = 'backtest'").first()
    assert (scored.start, scored.end, scored.annualized, scored.n_cycles) == ("2025-01-01", "", 0.1, 3)
    last = receipts.last_run_per_fund(found.withColumn("fund", F.lit("a")), tie="path").first()
    assert (last.total, last.excess, last.benchmark) == (0.1, 0.02, "SPY") and last.universe in (["A"], ["B"], ["C"])
    out = tmp_path / "out"
    receipts.write_receipts(spark.createDataFrame(docs, "fund STRING, body STRING"), str(out))
    assert spark.read.schema("body STRING, fund STRING").json(str(out)).count() == 6


def test_only_new_work(spark):
    asks = spark.createDataFrame([("A", date(2025, 1, 2)), ("B", date(2025, 1, 2))], "ticker STRING, end_date DATE")
    done = spark.createDataFrame([("A", date(2025, 1, 2), "2025-01-03 04:59:00"), ("B", date(2025, 1, 2), "2025-01-03 05:01:00")],
                                 "ticker STRING, end_date DATE, f STRING").withColumn("fetched_at", F.to_timestamp("f")).drop("f")
    assert [r.ticker for r in reads.only_new_work(asks, done, ["ticker", "end_date"]).collect()] == ["A"]


def test_universe_and_bars(spark):
    typed_in = spark.createDataFrame([(" aapl", 0), ("MSFT", 1), ("", 2), ("AAPL ", 3)], "ticker STRING, pos INT")
    assert sorted((r.ticker, r.pos) for r in reads.normalize_universe(typed_in).collect()) == [("AAPL", 0), ("MSFT", 1)]
    ticks = spark.createDataFrame([("A", f"2025-01-{d:02d} 10:00:00", float(d), 1, d) for d in (6, 7, 12, 13)],
                                  "ticker STRING, t STRING, price DOUBLE, volume BIGINT, id INT").withColumn("ts", F.to_timestamp("t"))
    weeks = reads.resample_bars(ticks, "week", tie="id").orderBy("bar").collect()
    assert [(r.bar.day, r.open, r.close, r.volume) for r in weeks] == [(6, 6.0, 12.0, 3), (13, 13.0, 13.0, 1)]
