"""Answers kept by content, and the batch store below them."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from panelmill.operators import judgments
from panelmill.sources.store import BatchTable

ROWS = "k string, v bigint, part string"


def table(spark, tmp_path):
    return BatchTable(spark, str(tmp_path / "t"), ROWS, "part")


def rows(spark, *given):
    return spark.createDataFrame([(k, v, k[:1]) for k, v in given], ROWS)


def test_batches_are_committed_once(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.rows().count() == 0 and t.manifest().count() == 0
    assert t.append(rows(spark, ("a", 1), ("b", 2)), "one") == 2
    assert t.append(rows(spark, ("c", 3)), "one") == 2  # committed already: left alone
    assert t.append(rows(spark), "empty") == 0
    assert t.append(rows(spark, ("c", 3)), "two") == 1
    assert sorted((r.k, r.v, r.batch) for r in t.rows().collect()) == [("a", 1, "one"), ("b", 2, "one"), ("c", 3, "two")]
    assert {r.batch: r.rows for r in t.manifest().collect()} == {"one": 2, "two": 1, "empty": 0}
    with pytest.raises(ValueError):
        t.append(rows(spark), "../x")


def test_a_batch_without_a_record_is_not_read_and_is_replaced(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(rows(spark, ("a", 1)), "one")
    # A run that died between its rows and its record, in a folder the next run does not write to.
    rows(spark, ("z", 9)).write.partitionBy("part").parquet(f"{t.path}/data/batch=two")
    assert [r.k for r in t.rows().collect()] == ["a"]
    assert t.append(rows(spark, ("b", 2)), "two") == 1
    assert sorted(r.k for r in t.rows().collect()) == ["a", "b"]


def asked(spark, cells):
    agents = spark.createDataFrame([("bull", "m", "be brave"), ("bear", "m", "be afraid")], "model_name string, engine string, instructions string")
    snaps = spark.createDataFrame([(t, date(2025, m, 1), "Tech", "Chips", text) for t, m, text in cells],
                                  "ticker string, as_of date, sector string, industry string, prompt string")
    return judgments.requests(snaps, agents)


def said(opened, text):
    return opened.select("prompt_key", F.lit(text).alias("text"))


def test_equal_snapshots_share_an_answer_and_are_asked_once(spark, tmp_path):
    memo = judgments.memo_table(spark, str(tmp_path / "memo"))
    first = asked(spark, [("A", 1, "p1"), ("A", 2, "p1"), ("B", 1, "p1"), ("A", 3, "p2")])
    assert first.count() == 8
    opened = judgments.open_requests(first, memo)
    assert opened.count() == 4  # two agents, two prompts
    assert {r.snapshot_key for r in first.where("ticker = 'A' AND prompt = 'p1'").collect()} != {r.snapshot_key for r in first.where("ticker = 'B'").collect()}
    good = '{"signal": "bullish", "confidence": 40, "reasoning": "x"}'
    assert judgments.add_answers(memo, opened, said(opened, good), "r1") == 4
    assert judgments.open_requests(first, memo).count() == 0
    more = asked(spark, [("A", 1, "p1"), ("A", 4, "p3")])
    assert {r.prompt for r in judgments.open_requests(more, memo).collect()} == {"p3"}
    got = judgments.judged_signals(more, memo).collect()
    assert {(r.date.month, r.value, r.abstained, r.reason, r.answered_in) for r in got} == {(1, 0.4, False, "", "r1"), (4, 0.0, True, "no answer", None)}


def test_a_refused_answer_stays_open_until_a_valid_one_comes(spark, tmp_path):
    memo = judgments.memo_table(spark, str(tmp_path / "memo"))
    panel = asked(spark, [("A", 1, "p1")])
    for run, text in (("r1", "no idea"), ("r2", '{"signal": "up", "confidence": 5}'), ("r3", '{"signal": "bearish", "confidence": 500}')):
        opened = judgments.open_requests(panel, memo)
        assert opened.count() == 2
        judgments.add_answers(memo, opened, said(opened, text), run)
    assert {(r.abstained, r.reason, r.value) for r in judgments.judged_signals(panel, memo).collect()} == {(True, "no JSON object found", 0.0)}
    opened = judgments.open_requests(panel, memo)
    judgments.add_answers(memo, opened, said(opened, '{"signal": "bearish", "confidence": 50}'), "r4")
    assert judgments.open_requests(panel, memo).count() == 0
    assert {(r.abstained, r.value, r.answered_in) for r in judgments.judged_signals(panel, memo).collect()} == {(False, -0.5, "r4")}
    # Two runs may answer the same question at the same time; the first by name counts.
    judgments.add_answers(memo, opened, said(opened, '{"signal": "bullish", "confidence": 50}'), "r0")
    assert judgments.judged_signals(panel, memo).agg(F.count("*"), F.max("value")).first()[:] == (2, 0.5)


def test_an_empty_panel_asks_nothing(spark, tmp_path):
    memo = judgments.memo_table(spark, str(tmp_path / "memo"))
    none = asked(spark, [("A", 1, "p1")]).where("false")
    assert judgments.open_requests(none, memo).count() == 0 and judgments.judged_signals(none, memo).count() == 0


def test_questions_are_opened_by_keys_and_get_their_texts_after(spark, tmp_path):
    memo = judgments.memo_table(spark, str(tmp_path / "memo"))
    full = asked(spark, [("A", 1, "p1"), ("A", 2, "p1"), ("B", 1, "p2")])
    opened = judgments.open_requests(full.drop("instructions", "prompt"), memo)
    assert opened.count() == 4 and "prompt" not in opened.columns
    texts = sorted((r.model_name, r.instructions, r.prompt) for r in judgments.open_texts(opened, full).collect())
    assert texts == [(m, i, p) for m, i in (("bear", "be afraid"), ("bull", "be brave")) for p in ("p1", "p2")]
    assert judgments.add_answers(memo, opened, said(opened, '{"signal": "bullish", "confidence": 50}'), "one") == 4
    assert judgments.open_requests(full.drop("instructions", "prompt"), memo).count() == 0
