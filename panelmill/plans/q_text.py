"""Scalar, text and answer-reading queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, scalar, text
from ..operators import snapshot
from .q_reads import ticker_grid
from .q_signals import SNAP_SQL
from .registry import query


@query("safe_float", """
    SELECT event_id, coalesce(CASE WHEN isfinite(v) THEN v END, 0.0::DOUBLE) AS parsed FROM (
      SELECT event_id, TRY_CAST(CASE event_id % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity'
        WHEN 3 THEN CAST(user_id AS VARCHAR) ELSE json_extract_string(props, '$.k') || '.5' END AS DOUBLE) AS v FROM events)""")
def safe_float(t):
    k = F.col("event_id") % 5
    raw = (
        F.when(k == 0, "n/a").when(k == 1, "NaN").when(k == 2, "Infinity")
        .when(k == 3, F.col("user_id").cast("string"))
        .otherwise(F.concat(F.get_json_object("props", "$.k"), F.lit(".5")))
    )
    return t.table("events").select("event_id", scalar.safe_float(raw).alias("parsed"))


@query("clamp", "SELECT event_id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (value - 15) / 10)) AS v FROM events")
def clamp(t):
    return t.table("events").select("event_id", scalar.clamp((F.col("value") - 15) / 10).alias("v"))


@query("squash", "SELECT event_id, round(tanh((value - 15) / 50 * 5), 9) AS v FROM events")
def squash(t):
    return t.table("events").select("event_id", F.round(scalar.squash((F.col("value") - 15) / 50), 9).alias("v"))


@query("humanize_number", """
    SELECT filing_id, CASE WHEN v IS NULL THEN '-' WHEN abs(v) >= 1e9 THEN printf('%.1fB', v / 1e9)
      WHEN abs(v) >= 1e6 THEN printf('%.1fM', v / 1e6) ELSE printf('%.2f', v) END AS label
    FROM (SELECT filing_id, CASE filing_id % 3 WHEN 0 THEN market_cap * 10 WHEN 1 THEN return_on_equity ELSE market_cap / 1000 END AS v
          FROM metrics)""", "metrics")
def humanize_number(t):
    k = F.col("filing_id") % 3
    v = F.when(k == 0, F.col("market_cap") * 10).when(k == 1, F.col("return_on_equity")).otherwise(F.col("market_cap") / 1000)
    return t.metrics.select("filing_id", text.humanize_number(v).alias("label"))


@query("money_label", """
    SELECT o_orderkey, CASE WHEN abs(v) >= 10000 THEN format('${:,}k', CAST(printf('%.0f', v / 1000) AS BIGINT))
       ELSE format('${:,}', CAST(printf('%.0f', v) AS BIGINT)) END AS label
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 100 ELSE o_totalprice / 50 END AS v FROM orders)""")
def money_label(t):
    v = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") * 100).otherwise(F.col("o_totalprice") / 50)
    return t.table("orders").select("o_orderkey", text.money_label(v).alias("label"))


@query("fold_conviction", """
    SELECT event_id, CASE word WHEN 'bullish' THEN 1.0 WHEN 'neutral' THEN 0.0 WHEN 'bearish' THEN -1.0 END::DOUBLE * k / 100 AS value
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
            CASE event_id % 4 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' WHEN 2 THEN 'neutral' END AS word FROM events)""")
def fold_conviction(t):
    e = F.col("event_id") % 4
    word = F.when(e == 0, "bullish").when(e == 1, "bearish").when(e == 2, "neutral")
    k = F.get_json_object("props", "$.k").cast("double")
    return t.table("events").select("event_id", scalar.fold_conviction(word, k).alias("value"))


@query("verdict_label", """
    SELECT ticker, date, model_name, upper(CASE WHEN abstained THEN 'abstain' WHEN k % 7 = 0 THEN 'neutral'
      WHEN value > 0 THEN 'bullish' WHEN value < 0 THEN 'bearish' ELSE 'neutral' END) AS verdict FROM signals""", "signals")
def verdict_label(t):
    stored = F.when(F.col("k") % 7 == 0, "neutral").when(F.col("k") % 5 == 0, "unknown")
    return t.signals.select(
        "ticker", "date", "model_name", scalar.verdict_label(F.col("value"), stored, F.col("abstained")).alias("verdict")
    )


@query("short_list_label", """
    SELECT fund, CASE WHEN len(names) = 0 THEN '—' WHEN len(names) <= 2 THEN array_to_string(names, ' ')
      ELSE array_to_string(names[1:2], ' ') || ' +' || (len(names) - 2) END AS label
    FROM (SELECT o_orderkey AS fund, [CAST(x AS VARCHAR) FOR x IN range(o_orderkey % 5)] AS names FROM orders)""")
def short_list_label(t):
    n = (F.col("o_orderkey") % 5).cast("int")
    names = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.sequence(F.lit(0), n - 1).cast("array<string>"))
    return t.table("orders").select(F.col("o_orderkey").alias("fund"), text.short_list_label(names).alias("label"))


@query("title_from_slug", """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE array_to_string(
      [upper(w[1]) || lower(w[2:]) FOR w IN string_split(replace(lower(p_type), ' ', '-'), '-')], ' ') END AS title FROM part""")
def title_from_slug(t):
    slug = F.replace(F.lower("p_type"), F.lit(" "), F.lit("-"))
    display = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))
    return t.table("part").select("p_partkey", text.title_from_slug(display, slug).alias("title"))


@query("content_key", """
    SELECT conv_id, turn, substr(sha256('agent|model|' || role || '|' || text), 1, 24) AS prompt_key FROM conversations""")
def content_key(t):
    return t.table("conversations").select(
        "conv_id", "turn",
        text.content_key(F.lit("agent"), F.lit("model"), F.col("role"), F.col("text")).alias("prompt_key"),
    )


@query("date_prefix", """
    SELECT event_id, CAST(ts AS DATE) AS day, CAST(ts AS DATE) - 1 AS day_before,
           date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS age FROM events""")
def date_prefix(t):
    day = scalar.day_of(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.table("events").select(
        "event_id", day.alias("day"), scalar.previous_day(day).alias("day_before"),
        F.datediff(day, F.lit("2024-01-01").cast("date")).cast("bigint").alias("age"),
    )


FMT = ("CASE WHEN {v} IS NULL THEN '-' WHEN abs({v}) >= 1e9 THEN printf('%.1fB', {v} / 1e9) "
       "WHEN abs({v}) >= 1e6 THEN printf('%.1fM', {v} / 1e6) ELSE printf('%.2f', {v}) END")


def _line(when: str) -> str:
    cells = " || ' | ' || ".join(
        FMT.format(v=f"k.{c}") if c else "'-'"
        for c in ("market_cap", "", "return_on_equity", "gross_margin", "", "net_margin", "debt_to_equity", "", "", "", "book_value_per_share", "")
    )
    return f"{when} || ' | ' || {cells}"


def prompt_text_sql(blind: bool = False) -> str:
    """Views that end in prompts: (ticker, as_of, sector, industry, prompt)."""
    when = "'t-' || (k.rank - 1)" if blind else "k.report_period || ' | ' || k.filing_date"
    head = ("'Company: (withheld)' || '  |  Sector: ' || f.sector" if blind
            else "'Company: ' || a.ticker || '  |  Sector: ' || f.sector || '  |  Industry: ' || f.industry")
    note = snapshot._NOTE_BLIND if blind else snapshot._NOTE_OPEN
    columns = ("period" if blind else "period | filed") + snapshot._COLUMNS
    parts = [
        head, f"'{note}'", "''", "'Summary:'",
        "'  Market cap (latest filed): ' || " + FMT.format(v="a.market_cap_latest"),
        "'  ROE avg: ' || " + FMT.format(v="a.roe_avg") + " || '  |  Net margin avg: ' || " + FMT.format(v="a.net_margin_avg"),
        "'  Gross margin trend (latest-oldest): ' || " + FMT.format(v="a.gross_margin_trend"),
        "'  Book value/share CAGR: ' || " + FMT.format(v="a.bvps_cagr"),
        "'  Debt/equity (latest): ' || " + FMT.format(v="a.debt_to_equity_latest"),
        "''", f"'{snapshot._HISTORY}'", f"'{columns}'",
    ]
    body = " || chr(10) || ".join(f"({p})" for p in parts)
    return f"""{SNAP_SQL},
    hist AS (SELECT k.ticker, k.as_of, string_agg({_line(when)}, chr(10) ORDER BY k.rank) AS h FROM known k GROUP BY 1, 2),
    prompts AS (
      SELECT a.ticker, a.as_of, f.sector, f.industry, {body} || chr(10) || h.h AS prompt
      FROM agg a JOIN facts f ON f.ticker = a.ticker JOIN hist h ON h.ticker = a.ticker AND h.as_of = a.as_of
      WHERE a.n_periods >= 4)"""


def _prompt_sql(blind: bool) -> str:
    return f"""
    WITH {prompt_text_sql(blind)}
    SELECT ticker, as_of, md5(prompt) AS prompt_digest, length(prompt) AS n_chars FROM prompts"""


def _prompts(t, blind: bool):
    snaps = snapshot.fundamentals_snapshot(ticker_grid(t), t.metrics, t.facts, with_periods=True)
    return snapshot.render_snapshot(snaps, blind=blind).select(
        "ticker", "as_of", F.md5("prompt").alias("prompt_digest"), F.length("prompt").cast("bigint").alias("n_chars")
    )


@query("render_snapshot", _prompt_sql(False), "facts market metrics")
def render_snapshot(t):
    return _prompts(t, blind=False)


@query("render_snapshot_blind", _prompt_sql(True), "facts market metrics")
def render_snapshot_blind(t):
    return _prompts(t, blind=True)


ANSWER_SQL = """
    WITH found AS (
      SELECT event_id, text, CASE WHEN json_valid(fence) THEN fence WHEN json_valid(trim(text)) THEN trim(text)
               WHEN json_valid(prose) THEN prose END AS json
      FROM (SELECT event_id, text, nullif(regexp_extract(text, '```(?:json)?\\s*(\\{.*?\\})\\s*```', 1, 's'), '') AS fence,
                   nullif(regexp_extract(text, '^[^{]*(\\{[^{}]*\\})', 1, 's'), '') AS prose FROM answers))"""


@query("extract_json_answer", f"{ANSWER_SQL} SELECT event_id, json FROM found", "answers")
def extract_json_answer(t):
    return t.answers.select("event_id", answers.extract_json_answer(F.col("text")).alias("json"))


@query("validate_answer", f"""{ANSWER_SQL},
    parts AS (SELECT event_id, json, lower(coalesce(json_extract_string(json, '$.signal'), '')) AS word,
                CAST(json_extract_string(json, '$.confidence') AS DOUBLE) AS conf, json_extract_string(json, '$.reasoning') AS reasoning FROM found),
    checked AS (SELECT *, CASE WHEN json IS NULL THEN 'no JSON object found'
        WHEN word NOT IN ('bullish', 'bearish', 'neutral') THEN 'invalid signal'
        WHEN conf IS NULL OR conf NOT BETWEEN 0 AND 100 THEN 'confidence out of range' END AS abstain_reason FROM parts)
    SELECT event_id, CASE WHEN abstain_reason IS NULL THEN word END AS signal, CASE WHEN abstain_reason IS NULL THEN conf END AS confidence,
           CASE WHEN abstain_reason IS NULL THEN reasoning END AS reasoning,
           CASE WHEN abstain_reason IS NULL THEN CASE word WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END::DOUBLE * conf / 100
             ELSE 0.0 END::DOUBLE AS value, abstain_reason IS NOT NULL AS abstained, abstain_reason FROM checked""", "answers")
def validate_answer(t):
    return answers.validate_answers(t.answers.select("event_id", "text")).drop("text")


def typed_responses(t):
    """A typed answer per event; every eleventh has bad probabilities, every thirteenth a wrong type."""
    e = F.col("event_id")
    choice = F.when(e % 3 == 0, "bullish").when(e % 3 == 1, "bearish").otherwise("neutral")
    spread = F.when(e % 11 == 0, "0.9").otherwise("0.5")
    strength = F.lit('"probabilities": {"0": 0.2, "1": 0.2, "2": 0.2, "3": 0.2, "4": 0.2}, "confidence": 0.7, "score": ')
    body = F.concat(
        F.lit('{"answers": {"direction": {"type": "'), F.when(e % 13 == 0, "score").otherwise("choice"),
        F.lit('", "choice": "'), choice, F.lit('", "confidence": 0.5, "probabilities": {"bullish": '), spread,
        F.lit(', "bearish": 0.25, "neutral": 0.25}}, "bullish_strength": {"type": "score", '), strength,
        (e % 5).cast("string"), F.lit('}, "bearish_strength": {"type": "score", '), strength, (e % 4).cast("string"), F.lit("}}}"),
    )
    return t.table("events").select("event_id", body.alias("body"))


@query("normalize_typed_answer", """
    WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'bullish' WHEN 1 THEN 'bearish' ELSE 'neutral' END AS signal,
        CASE event_id % 3 WHEN 0 THEN (event_id % 5) * 25.0 WHEN 1 THEN (event_id % 4) * 25.0 ELSE 0.0 END::DOUBLE AS confidence,
        CASE WHEN event_id % 13 = 0 THEN 'direction must be a choice answer'
             WHEN event_id % 11 = 0 THEN 'direction.probabilities invalid' END AS error FROM events)
    SELECT event_id, CASE WHEN error IS NULL THEN signal END AS signal, CASE WHEN error IS NULL THEN confidence END AS confidence, error FROM e""")
def normalize_typed_answer(t):
    return answers.normalize_typed_answers(typed_responses(t)).drop("body")


@query("salvage_partial_answer", """
    SELECT event_id, lower(nullif(regexp_extract(text, '"signal"\\s*:\\s*"([A-Za-z]+)"', 1), '')) AS signal,
           TRY_CAST(nullif(regexp_extract(text, '"confidence"\\s*:\\s*(-?\\d+(?:\\.\\d+)?)\\s*[,}]', 1), '') AS DOUBLE) AS confidence,
           regexp_extract(text, '"reasoning"\\s*:\\s*"([^"]*)', 1) AS thesis FROM answers""", "answers")
def salvage_partial_answer(t):
    return answers.salvage_partial(t.answers.select("event_id", "text")).drop("text")


@query("flatten_blocks", """
    SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN 'said:' || chr(10) || text ELSE '' END AS flat
    FROM conversations""")
def flatten_blocks(t):
    block = F.to_json(F.array(F.struct(F.lit("thinking").alias("type"), F.col("role").alias("text")),
                              F.struct(F.lit("text").alias("type"), F.col("text"))))
    listed = F.concat(F.lit('["said:", '), F.substring(block, 2, F.length(block)))
    none = F.lit('[{"type": "thinking", "text": "hidden"}]')
    content = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, listed).otherwise(none)
    return t.table("conversations").select("conv_id", "turn", text.flatten_blocks(content).alias("flat"))


@query("redact", "SELECT conv_id, turn, replace(text, 'le', '[REDACTED]') AS text FROM conversations")
def redact(t):
    return t.table("conversations").select("conv_id", "turn", text.redact(F.col("text"), "le").alias("text"))


@query("round_half", """
    SELECT filing_id, printf('%.2f', book_value_per_share)::DOUBLE AS bvps, printf('%.1f', market_cap / 1e6)::DOUBLE AS cap FROM metrics
    """, "metrics")
def round_half(t):
    return t.metrics.select(
        "filing_id", scalar.round_exact(F.col("book_value_per_share"), 2).alias("bvps"),
        scalar.round_exact(F.col("market_cap") / 1e6, 1).alias("cap"),
    )
