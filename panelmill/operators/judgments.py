"""Answers of outside models, kept by content and turned into signals.

A request is one agent's question about one snapshot. Its key hashes the agent, the model and the
texts, never the date, so dates between filings and unchanged snapshots share one answer, and what was
answered once is not asked again. Answers that could not be read or break a rule are kept beside the
others for inspection; their questions stay open, and until one is answered the signal abstains with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import validate_answers
from ..functions.text import content_key, row_key
from ..sources.store import BatchTable
from .keyed import pick_per_key
from .signals import request_grid

AGENT_COLUMNS = ("model_name", "engine", "instructions")
MEMO = (
    "prompt_key string, model_name string, engine string, snapshot_key string, text string, value double, "
    "abstained boolean, reason string, prefix string"
)
#: Digits of a key that name its folder: 16 folders a batch, 256 with two digits for stores of many billions.
PREFIX_LENGTH = 1


def memo_table(spark: SparkSession, path: str) -> BatchTable:
    """The store of answers; rows spread over folders by the first digits of their key."""
    return BatchTable(spark, path, MEMO, "prefix")


def _prefix() -> Column:
    return F.substring("prompt_key", 1, PREFIX_LENGTH)


def requests(snapshots: DataFrame, agents: DataFrame) -> DataFrame:
    """Every snapshot (ticker, as_of, sector, industry, prompt) asked of every agent, with both content keys.

    ``snapshot_key`` hashes what the snapshot says without its date. The keys are made before a snapshot is
    unfolded to the agents.
    """
    keyed = snapshots.select(
        "ticker", "as_of", "prompt", row_key(["ticker", "sector", "industry", "prompt"]).alias("snapshot_key")
    )
    asked = request_grid(keyed, agents.select(*AGENT_COLUMNS))
    key = content_key(F.col("model_name"), F.col("engine"), F.col("instructions"), F.col("prompt"))
    return asked.withColumn("prompt_key", key)


def known_answers(memo: BatchTable) -> DataFrame:
    """One answer a key: a valid one if there is any, of several the first batch by name."""
    return pick_per_key(memo.rows().drop("prefix"), ["prompt_key"], [F.col("abstained"), F.col("batch")], last=False)


def open_requests(asked: DataFrame, memo: BatchTable) -> DataFrame:
    """Questions without a valid answer, each content once; the prompt of equal keys is equal.

    *asked* may come without its texts (instructions, prompt), as a stored panel should: ``open_texts`` adds
    them to the questions that are open.
    """
    columns = [c for c in ("model_name", "engine", "instructions", "prompt", "snapshot_key") if c in asked.columns]
    once = asked.groupBy("prompt_key").agg(*[F.min(c).alias(c) for c in columns])
    known = memo.rows().where(~F.col("abstained")).select("prefix", "prompt_key").distinct()
    return once.withColumn("prefix", _prefix()).join(known, ["prefix", "prompt_key"], "left_anti")


def open_texts(opened: DataFrame, asked: DataFrame) -> DataFrame:
    """*opened* questions with their instructions and prompt, which only *asked* holds; each content once."""
    texts = asked.select("prompt_key", "instructions", "prompt").join(opened.select("prompt_key"), "prompt_key", "left_semi")
    once = texts.groupBy("prompt_key").agg(F.min("instructions").alias("instructions"), F.min("prompt").alias("prompt"))
    return opened.join(once, "prompt_key")


def add_answers(memo: BatchTable, opened: DataFrame, answers: DataFrame, batch: str) -> int:
    """Check the *answers* (prompt_key, text) to *opened* questions and commit them; how many rows were added.

    Valid answers carry a value; any other is an abstention with the reason it was refused for.
    """
    checked = validate_answers(answers.select("prompt_key", "text")).select(
        "prompt_key", "text", "value", "abstained", F.coalesce("abstain_reason", F.lit("")).alias("reason")
    )
    rows = opened.select("prefix", "prompt_key", "model_name", "engine", "snapshot_key").join(checked, "prompt_key")
    return memo.append(rows, batch)


def judged_signals(asked: DataFrame, memo: BatchTable) -> DataFrame:
    """A signal for every request: its answer's value, or an abstention where there is no valid one."""
    known = known_answers(memo).select("prompt_key", "value", "abstained", "reason", "batch")
    met = asked.drop("prompt", "instructions").join(known, "prompt_key", "left")
    return met.select(
        "model_name", "ticker", F.col("as_of").alias("date"), F.coalesce("value", F.lit(0.0)).alias("value"),
        F.coalesce("abstained", F.lit(True)).alias("abstained"), F.coalesce("reason", F.lit("no answer")).alias("reason"),
        "prompt_key", "snapshot_key", F.col("batch").alias("answered_in"),
    )
