"""Answers of outside models by content, over two runs of the same panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judgments, snapshot
from ..session import scratch_path, stored
from .datasets import duck
from .q_reads import ticker_grid
from .q_text import prompt_text_sql
from .registry import query

# Read by both engines.
AGENTS = """(VALUES ('value', 'm1', 'Judge by price and assets.'), ('growth', 'm1', 'Judge by margins and growth.'))
  AS t(model_name, engine, instructions)"""
# The outside model is stood in for by a rule over the key's hex digits: some answers have no JSON, some an
# unknown word, some a confidence out of range.
ANSWER_TEXT = """
    CASE WHEN {key_1} IN ('0', '1') THEN 'I have no view.'
         ELSE '{{"signal": "' || CASE WHEN {key_2} < '6' THEN 'bullish' WHEN {key_2} < 'b' THEN 'Bearish' WHEN {key_2} < 'f' THEN 'neutral' ELSE 'unsure' END
              || '", "confidence": ' || CASE WHEN {key_3} = 'f' THEN '150' ELSE CAST(ascii({key_3}) % 10 * 11 AS {text}) END || ', "reasoning": "r"}}' END"""


def answer_text(text: str) -> str:
    return ANSWER_TEXT.format(text=text, **{f"key_{i}": f"substr(prompt_key, {i}, 1)" for i in (1, 2, 3)})


def _asked(t):
    """The panel's requests by their keys; a prompt is as long as its filings, and none is read once it is hashed."""
    snaps = snapshot.fundamentals_snapshot(ticker_grid(t), t.metrics, t.facts, with_periods=True)
    agents = t.literal(AGENTS)
    return stored(judgments.requests(snapshot.render_snapshot(snaps), agents).drop("instructions", "prompt"), "requests")


def _run(memo, asked, batch):
    """One run: find open questions, have them answered, add what came back."""
    opened = stored(judgments.open_requests(asked, memo), "open")
    said = opened.withColumn("text", F.expr(answer_text("STRING")))
    added = judgments.add_answers(memo, opened, said.select("prompt_key", "text"), batch)
    return opened, added


ASKED_SQL = f"""
    agents AS (SELECT * FROM {duck(AGENTS)}),
    asked AS (
      SELECT g.model_name, g.engine, p.ticker, p.as_of, substr(sha256(g.model_name || '|' || g.engine || '|' || g.instructions || '|' || p.prompt), 1, 24) AS prompt_key,
             substr(sha256(to_json(struct_pack(ticker := p.ticker, sector := p.sector, industry := p.industry, prompt := p.prompt))), 1, 24) AS snapshot_key
      FROM prompts p, agents g),
    said AS (SELECT *, {answer_text("VARCHAR")} AS text FROM (SELECT DISTINCT prompt_key FROM asked)),
    read AS (
      SELECT prompt_key, CASE WHEN raw NOT LIKE '%}}%' THEN 'no JSON object found'
                              WHEN lower(json_extract_string(text, '$.signal')) NOT IN ('bullish', 'bearish', 'neutral') THEN 'invalid signal'
                              WHEN CAST(json_extract_string(text, '$.confidence') AS DOUBLE) > 100 THEN 'confidence out of range' ELSE '' END AS reason,
             CASE lower(json_extract_string(text, '$.signal')) WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END::DOUBLE
               * CAST(json_extract_string(text, '$.confidence') AS DOUBLE) / 100 AS value
      FROM (SELECT prompt_key, CASE WHEN text LIKE '%}}%' THEN text ELSE '{{}}' END AS text, text AS raw FROM said))"""


@query("answers_by_content", f"""
    WITH {prompt_text_sql()}, {ASKED_SQL}
    SELECT a.model_name, a.ticker, a.as_of AS date, CASE WHEN r.reason = '' THEN r.value ELSE 0.0 END AS value, r.reason <> '' AS abstained, r.reason,
           a.prompt_key, a.snapshot_key, 'run-1' AS answered_in
    FROM asked a JOIN read r ON r.prompt_key = a.prompt_key""", "facts market metrics")
def answers_by_content(t):
    """Signals of all (agent, ticker, month end): equal snapshots share one answer."""
    asked = _asked(t)
    memo = judgments.memo_table(t.spark, scratch_path(t.spark, "answers"))
    _run(memo, asked, "run-1")
    return judgments.judged_signals(asked, memo)


@query("answer_runs", f"""
    WITH {prompt_text_sql()}, {ASKED_SQL},
    refused AS (SELECT count(*) AS n FROM read WHERE reason <> '')
    SELECT 'run-1' AS run, (SELECT count(*) FROM asked) AS n_asked, count(*) AS n_open, count(*) AS n_added, count(*) FILTER (WHERE reason = '') AS n_valid FROM read
    UNION ALL SELECT 'run-2', (SELECT count(*) FROM asked), n, n, 0 FROM refused
    UNION ALL SELECT 'run-2 again', (SELECT count(*) FROM asked), n, 0, 0 FROM refused""", "facts market metrics")
def answer_runs(t):
    """What each run found open and added: the second asks only what was refused, and repeating a run adds nothing."""
    asked = _asked(t)
    memo = judgments.memo_table(t.spark, scratch_path(t.spark, "answers"))
    n_asked, before, rows = asked.count(), (0, 0), []
    for run, batch in (("run-1", "run-1"), ("run-2", "run-2"), ("run-2 again", "run-2")):
        opened, _ = _run(memo, asked, batch)
        held = memo.rows().agg(F.count("*"), F.count_if(~F.col("abstained"))).first()
        rows.append((run, n_asked, opened.count(), held[0] - before[0], held[1] - before[1]))
        before = held
    return t.spark.createDataFrame(rows, "run string, n_asked bigint, n_open bigint, n_added bigint, n_valid bigint")
