"""Reading model answers kept as text: find the JSON, check it, salvage a cut one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import DIRECTION_SIGN, fold_conviction

# Where answers carry their JSON, and the three fields of a partial answer.
FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
SIGNAL = r'"signal"\s*:\s*"([A-Za-z]+)"'
CONFIDENCE = r'"confidence"\s*:\s*(-?\d+(?:\.\d+)?)\s*[,}]'
REASONING = r'(?s)"reasoning"\s*:\s*"((?:[^"\\]|\\u[0-9a-fA-F]{4}|\\[^u])*)'


def _valid(json: Column) -> Column:
    return F.when(F.try_parse_json(json).isNotNull(), json)


def _first_match(text: Column, pattern: str) -> Column:
    """Group 1 of the first match; null where nothing, or only empty text, is matched."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def balanced_block(text: Column) -> Column:
    """From the first opening brace to the closing brace that balances it.

    The text is cut at closing braces; the block ends at the first cut where as
    many braces were opened as closed.
    """
    tail = F.when(
        F.instr(text, "{") > 0, F.substring(text, F.instr(text, "{"), F.length(text))
    )
    pieces = F.split(tail, "}", -1)
    closed = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def step(state: Column, piece: Column) -> Column:
        opened = state["opened"] + F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
        cut = state["cut"] + 1
        moved = F.struct(opened.alias("opened"), cut.alias("cut"), (opened == cut).alias("done"))
        return F.when(state["done"], state).otherwise(moved)

    start = F.struct(
        F.lit(0).alias("opened"), F.lit(0).alias("cut"), F.lit(False).alias("done")
    )
    cuts = F.aggregate(closed, start, step, lambda s: F.when(s["done"], s["cut"]))
    return F.when(cuts.isNotNull(), F.concat(F.call_function("substring_index", tail, F.lit("}"), cuts), F.lit("}")))


def extract_json_answer(text: Column) -> Column:
    """JSON text of an answer: a fenced object, the whole text, or the first balanced braces.

    Each step runs only on rows the earlier ones left null.
    """
    fenced = F.when(F.contains(text, F.lit("```")), _valid(_first_match(text, FENCE)))
    return F.coalesce(fenced, _valid(F.trim(text)), _valid(balanced_block(text)))


def validate_answers(answers: DataFrame, text: str = "text") -> DataFrame:
    """Signal value of each answer, or an abstention with its reason.

    The direction must be known, the confidence within 0..100 (0 when absent), and provider
    metadata, where there is any, an object.
    """
    found = answers.withColumn("_json", extract_json_answer(F.col(text)))
    read = found.withColumn("_f", F.from_json("_json", "map<string,string>"))

    def field(name: str) -> Column:
        return F.try_element_at("_f", F.lit(name))

    absent = ~F.map_contains_key("_f", "confidence")
    checked = read.select(
        *answers.columns, "_json", field("reasoning").alias("_said"), F.col("_f").isNotNull().alias("_object"),
        F.lower(F.coalesce(field("signal"), F.lit(""))).alias("_word"),
        F.when(absent, 0.0).otherwise(field("confidence").try_cast("double")).alias("_conf"),
        F.when(F.map_contains_key("_f", "provider_metadata"), F.coalesce(F.startswith(F.trim(field("provider_metadata")), F.lit("{")), F.lit(False)))
        .otherwise(True).alias("_meta"),
    )
    reason = (
        F.when(F.col("_json").isNull(), "no JSON object found")
        .when(~F.col("_object"), "answer is not an object")
        .when(~F.col("_word").isin(*DIRECTION_SIGN), "invalid signal")
        .when(F.col("_conf").isNull() | ~F.col("_conf").between(0, 100), "confidence out of range")
        .when(~F.col("_meta"), "provider metadata is not an object")
    )
    done = checked.withColumn("abstain_reason", reason)
    ok = F.col("abstain_reason").isNull()
    return done.select(
        *answers.columns,
        F.when(ok, F.col("_word")).alias("signal"),
        F.when(ok, F.col("_conf")).alias("confidence"),
        F.when(ok, F.coalesce("_said", F.lit(""))).alias("reasoning"),
        F.when(ok, fold_conviction(F.col("_word"), F.col("_conf"))).otherwise(0.0).alias("value"),
        (~ok).alias("abstained"),
        "abstain_reason",
    )


_CHOICE = "STRUCT<type: STRING, choice: STRING, confidence: DOUBLE, probabilities: MAP<STRING, DOUBLE>>"
_SCORE = "STRUCT<type: STRING, score: DOUBLE, confidence: DOUBLE, probabilities: MAP<STRING, DOUBLE>>"
TYPED_SCHEMA = (
    f"STRUCT<answers: STRUCT<direction: {_CHOICE}, bullish_strength: {_SCORE}, bearish_strength: {_SCORE}>>"
)
_POINTS_PER_STEP = 25


def _in_range(value: Column, upper: float) -> Column:
    return F.coalesce(value.between(0, upper) & ~F.isnan(value), F.lit(False))


def _distribution_ok(probabilities: Column, keys: tuple[str, ...]) -> Column:
    values = F.map_values(probabilities)
    same_keys = F.array_sort(F.map_keys(probabilities)) == F.array(*[F.lit(k) for k in sorted(keys)])
    each = F.forall(values, lambda p: _in_range(p, 1))
    total = F.aggregate(values, F.lit(0.0), lambda acc, p: acc + p)
    return F.coalesce(same_keys & each & (F.abs(total - 1.0) <= 0.001), F.lit(False))


def normalize_typed_answers(responses: DataFrame, body: str = "body") -> DataFrame:
    """Direction and conviction of typed answers, or the first rule a response breaks.

    A strength of 0..4 is worth 25 points a step; neutral carries no conviction.
    """
    parsed = responses.withColumn("_a", F.from_json(body, TYPED_SCHEMA)["answers"])
    a = F.col("_a")
    rules = [(a.isNotNull(), "answers must be an object")]
    strengths = ("bullish_strength", "bearish_strength")
    for name, kind, keys in (
        ("direction", "choice", tuple(DIRECTION_SIGN)),
        *((s, "score", tuple("01234")) for s in strengths),
    ):
        part = a[name]
        rules += [
            (part["type"] == kind, f"{name} must be a {kind} answer"),
            (_in_range(part["confidence"], 1), f"{name}.confidence out of range"),
            (_distribution_ok(part["probabilities"], keys), f"{name}.probabilities invalid"),
        ]
        if kind == "score":
            rules.append((_in_range(part["score"], 4), f"{name}.score out of range"))
    rules.append((a["direction"]["choice"].isin(*DIRECTION_SIGN), "direction.choice unknown"))
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in rules])
    choice = a["direction"]["choice"]
    strength = F.when(choice == "bullish", a["bullish_strength"]["score"]).when(
        choice == "bearish", a["bearish_strength"]["score"]
    )
    conviction = F.coalesce(strength * _POINTS_PER_STEP, F.lit(0.0))
    checked = parsed.withColumn("error", error)
    fine = F.col("error").isNull()
    return checked.select(
        *responses.columns,
        F.when(fine, choice).alias("signal"),
        F.when(fine, conviction).alias("confidence"),
        "error",
    )


def salvage_partial(answers: DataFrame, text: str = "text") -> DataFrame:
    """Fields of an answer that may be cut off.

    A confidence counts only once its terminator arrived; the reasoning is read
    up to its closing quote, the end, or an escape that is not complete.
    """
    body = _first_match(F.col(text), REASONING)
    options = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}
    decoded = F.from_json(F.concat(F.lit('["'), body, F.lit('"]')), "array<string>", options)[0]
    return answers.select(
        *answers.columns,
        F.lower(_first_match(F.col(text), SIGNAL)).alias("signal"),
        _first_match(F.col(text), CONFIDENCE).cast("double").alias("confidence"),
        F.coalesce(decoded, F.lit("")).alias("thesis"),
    )


def verdict_so_far(signal: Column, confidence: Column) -> Column:
    """Upper-case call with its confidence once that is final."""
    return F.when(confidence.isNull(), F.upper(signal)).otherwise(
        F.concat(F.upper(signal), F.lit(" "), F.format_number(confidence, 0), F.lit("%"))
    )
