"""Signals to weights: blending, sleeves, netting, attribution, validation.

Books are long tables keyed by (fund, strategy, as_of, ticker). Cross-section
totals are aggregated and joined back, so a fund with a huge universe is never
one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import stored
from .asof import carry_forward
from .bookrules import broken_rules
from .checks import finite, missing_keys, require, violations
from .keyed import with_totals
from .risk import apply_limits, clamp_audit

TOLERANCE = 1e-9
MODES = ("long_only", "long_short", "dollar_neutral")
APPROACHES = ("long_only", "long_short")


def _total(values: Column) -> Column:
    return F.coalesce(F.sum(values), F.lit(0.0))


def staff(signals: DataFrame, models: DataFrame, strategies: DataFrame) -> DataFrame:
    """Each signal beside every strategy that employs its model; a model without a vote is an error.

    Mandate tables hold a few rows per fund; the planner broadcasts them when
    their size statistics say so.
    """
    mandate = strategies.select("fund", "strategy", "mode", "gross_target").join(
        models.select("strategy", "model_name", F.col("weight").alias("vote"), "approach"), "strategy"
    )
    staffed = signals.join(mandate, "model_name", "left")
    return require(staffed, {"model has no vote weight": F.col("strategy").isNotNull()})


def unstaffed(signals: DataFrame, models: DataFrame) -> DataFrame:
    """Models that signal but have no weight anywhere: must be empty for a valid mandate."""
    return missing_keys(signals, models, ["model_name"])


def input_violations(signals: DataFrame, models: DataFrame, strategies: DataFrame) -> DataFrame:
    """Every broken input rule as (rule, subject)."""
    v = F.col("value")
    bad_signals = violations(
        signals, {"signal must be finite and within [-1, 1]": finite(v) & v.between(-1, 1)},
        ["model_name", "ticker", "date"],
    ).select("rule", F.concat_ws(":", "model_name", "ticker", F.col("date").cast("string")).alias("subject"))
    w, g = F.col("weight"), F.col("gross_target")
    bad_models = violations(
        models, {
            "vote weight must be finite and positive": finite(w) & (w > 0),
            "approach must be long_only or long_short": F.col("approach").isin(*APPROACHES),
        }, ["strategy", "model_name"],
    ).select("rule", F.concat_ws(":", "strategy", "model_name").alias("subject"))
    bad_strategies = violations(
        strategies, {
            "gross target must be finite and positive": finite(g) & (g > 0),
            "mode is unknown": F.col("mode").isin(*MODES),
        }, ["fund", "strategy"],
    ).select("rule", F.concat_ws(":", "fund", "strategy").alias("subject"))
    unknown = unstaffed(signals, models).select(
        F.lit("model has no vote weight").alias("rule"), F.col("model_name").alias("subject")
    )
    return bad_signals.unionByName(bad_models).unionByName(bad_strategies).unionByName(unknown)


def blend_convictions(
    staffed: DataFrame, keys: Sequence[str] = ("fund", "strategy", "mode", "gross_target", "date", "ticker")
) -> DataFrame:
    """Weighted mean vote per ticker, and the mean that may justify a short.

    Abstentions do not vote, neutral votes do; a long-only model's negative vote
    counts as zero in the second mean. All abstaining gives 0.
    """
    value, vote = F.col("value"), F.col("vote")
    staffed = require(staffed, {
        "signal must be finite and within [-1, 1]": finite(value) & value.between(-1, 1),
        "vote weight must be finite and positive": finite(vote) & (vote > 0),
        "approach must be long_only or long_short": F.col("approach").isin(*APPROACHES),
        "abstained must be known": F.col("abstained").isNotNull(),
    })
    votes = ~F.col("abstained")
    weight = F.when(votes, F.col("vote"))
    short_value = F.when(F.col("approach") == "long_short", F.col("value")).otherwise(
        F.greatest(F.col("value"), F.lit(0.0))
    )
    summed = staffed.groupBy(*keys).agg(
        F.sum(weight * F.col("value")).alias("_v"),
        F.sum(weight * short_value).alias("_s"),
        F.sum(weight).alias("_w"),
        F.count("*").alias("n_signals"),
        F.sum(F.when(votes, 0).otherwise(1)).alias("n_abstained"),
    )
    return summed.select(
        *keys,
        F.coalesce(F.col("_v") / F.col("_w"), F.lit(0.0)).alias("conviction"),
        F.coalesce(F.col("_s") / F.col("_w"), F.lit(0.0)).alias("short_conviction"),
        "n_signals", "n_abstained",
    )


def sleeve_weights(
    blended: DataFrame, keys: Sequence[str] = ("fund", "strategy", "date")
) -> DataFrame:
    """Scores scaled to each strategy's gross target; a one-sided neutral book stays flat."""
    target = F.col("gross_target")
    blended = require(blended, {
        "mode is unknown": F.col("mode").isin(*MODES),
        "gross target must be finite and positive": finite(target) & (target > 0),
    })
    short_part = F.when(F.col("mode") == "long_only", 0.0).otherwise(
        F.least("short_conviction", F.lit(0.0))
    )
    scored = blended.withColumn("score", F.greatest("conviction", F.lit(0.0)) + short_part)
    sized = with_totals(
        scored, list(keys),
        _long=_total(F.greatest("score", F.lit(0.0))), _short=_total(-F.least("score", F.lit(0.0))),
    )
    neutral = F.col("mode") == "dollar_neutral"
    no_long, no_short = F.col("_long") < TOLERANCE, F.col("_short") < TOLERANCE
    empty = F.when(neutral, no_long & no_short).otherwise(F.col("_long") + F.col("_short") < TOLERANCE)
    reason = (
        F.when(empty, "no_eligible_positions")
        .when(neutral & no_long, "missing_long_side")
        .when(neutral & no_short, "missing_short_side")
    )
    side = F.when(F.col("score") > 0, F.col("_long")).otherwise(F.col("_short"))
    base = F.when(neutral, side).otherwise(F.col("_long") + F.col("_short"))
    target = F.when(neutral, F.col("gross_target") / 2).otherwise(F.col("gross_target"))
    flagged = sized.withColumn("flat_reason", reason)
    weight = F.when(F.col("flat_reason").isNotNull(), 0.0).otherwise(F.col("score") / base * target)
    return flagged.withColumn("weight", weight).drop("_long", "_short")


def strategy_slices(strategies: DataFrame) -> DataFrame:
    """Each strategy's share of its fund's capital."""
    w = F.col("weight")
    strategies = require(strategies, {"strategy weight must be finite and positive": finite(w) & (w > 0)})
    shared = with_totals(strategies, ["fund"], _total=F.sum("weight"))
    return shared.select("fund", "strategy", (F.col("weight") / F.col("_total")).alias("slice"))


def net_sleeves(sleeves: DataFrame, slices: DataFrame) -> DataFrame:
    """Fund book: strategy weights times capital slices, summed per ticker."""
    return (
        sleeves.join(slices, ["fund", "strategy"])
        .groupBy("fund", "date", "ticker")
        .agg(F.sum(F.col("slice") * F.col("weight")).alias("netted"))
    )


def preserves_proportions(strategies: DataFrame) -> DataFrame:
    """Funds with a dollar-neutral strategy scale their whole book by one factor."""
    return strategies.groupBy("fund").agg(F.bool_or(F.col("mode") == "dollar_neutral").alias("proportional"))


def final_contributions(sleeves: DataFrame, slices: DataFrame, risked: DataFrame) -> DataFrame:
    """The final book attributed back to strategies.

    *risked* carries netted, final and, in proportional books, the common factor.
    Offsetting legs that net to exactly zero keep multiplier 1 and stay visible.
    """
    multiplier = F.coalesce(
        F.col("factor"), F.when(F.col("netted") != 0, F.col("final") / F.col("netted")).otherwise(1.0)
    )
    book = risked.select("fund", "date", "ticker", multiplier.alias("multiplier"))
    return (
        sleeves.join(slices, ["fund", "strategy"])
        .join(book, ["fund", "date", "ticker"])
        .withColumn("contribution", F.col("slice") * F.col("weight") * F.col("multiplier"))
    )


class Assessment(NamedTuple):
    """What one assessment of a panel yields; every table is keyed by fund and date."""

    book: DataFrame  # final weights with mark, netted weight and limits
    sleeves: DataFrame  # recorded scores, weights and slices
    contributions: DataFrame
    audit: DataFrame  # limits that fired
    violations: DataFrame
    skipped: DataFrame  # (ticker, date, reason) of names with a vote and no usable mark

    def report(self) -> DataFrame:
        """One row per (fund, date): names, exposure before and after limits, limits fired, rules broken."""
        size = self.book.groupBy("fund", "date").agg(
            F.count("*").alias("n_names"), _total(F.abs("netted")).alias("gross_before"), _total(F.abs("final")).alias("gross_final"),
            _total(F.col("final")).alias("net_final"),
        )
        fired = self.audit.groupBy("fund", "date").agg(
            F.count_if(F.col("ticker").isNotNull()).alias("n_position_clamps"), F.count_if(F.col("ticker").isNull()).alias("n_gross_clamps")
        )
        broken = self.violations.groupBy("fund", "date").agg(F.count("*").alias("n_violations"))
        missed = self.skipped.groupBy("date").agg(F.count("*").alias("n_skipped"))
        joined = size.join(fired, ["fund", "date"], "left").join(broken, ["fund", "date"], "full").join(missed, "date", "left")
        return joined.fillna(0, ["n_position_clamps", "n_gross_clamps", "n_violations", "n_skipped"])


def assess(
    signals: DataFrame, marks: DataFrame, models: DataFrame, strategies: DataFrame, funds: DataFrame, *,
    now: Column, lookback: int = 7, observation: Observation | None = None,
) -> Assessment:
    """Assess every (fund, date) of a panel at once, over names with a recent mark.

    Signals dated on or after the New York date of *now* stop the job: their day is not complete. Signals
    meet the latest close of the last *lookback* days; blending, sleeves, netting, limits and
    attribution follow with fund and date as keys, and the recorded book is checked against evidence worked
    out again from the signals. Sleeves and book are stored, since several tables are read off them.
    With *observation*, the pass that writes the book also counts its names, the names over their cap
    before limits, and final weights that are not finite or over the cap.
    """
    today = F.to_date(F.from_utc_timestamp(now, "America/New_York"))
    # In the column and not in a filter: the planner would carry a filter on a join key over to the marks, which reach further.
    complete = F.when(F.col("date") < today, F.col("date")).otherwise(F.raise_error(F.lit("assessment of a day that is not complete")).cast("date"))
    signals = signals.withColumn("date", complete)
    known = carry_forward(marks, ["ticker"], "d", tolerance=lookback, as_of="date").select(
        "ticker", "date", F.col("close").alias("mark")
    )
    known = known.where(finite(F.col("mark")) & (F.col("mark") > 0))
    tradeable = signals.join(known, ["ticker", "date"], "left_semi")
    skipped = signals.select("ticker", "date").distinct().join(known, ["ticker", "date"], "left_anti").withColumn(
        "reason", F.lit(f"no usable close within {lookback} days")
    )
    slices = strategy_slices(strategies)
    evidence = sleeve_weights(blend_convictions(staff(tradeable, models, strategies)))
    sleeves = stored(evidence.join(slices, ["fund", "strategy"]), "sleeves")
    weights = sleeves.drop("slice")
    book = apply_limits(net_sleeves(weights, slices), funds, preserves_proportions(strategies)).join(known, ["ticker", "date"])
    if observation is not None:
        cap = F.col("max_position_pct")
        book = book.observe(
            observation, F.count("*").alias("n_names"), F.count_if(F.abs("netted") > cap).alias("n_over_cap"),
            F.count_if(~finite(F.col("final"))).alias("n_not_finite"), F.count_if(F.abs("final") > cap + TOLERANCE).alias("n_broken_cap"),
        )
    book = stored(book, "book")
    parts = final_contributions(weights, slices, book).select("fund", "strategy", "date", "ticker", "contribution")
    found = broken_rules(sleeves, parts, book, evidence, strategies, funds)
    return Assessment(book, sleeves, parts, clamp_audit(book), found, skipped)


def validate_book(
    sleeves: DataFrame, evidence: DataFrame, contributions: DataFrame, finals: DataFrame,
    strategies: DataFrame, funds: DataFrame,
) -> DataFrame:
    """Rule violations of a recorded book as (rule, fund, strategy, date, ticker, observed, bound).

    *evidence* is the book recomputed from signals (score, flat_reason);
    *sleeves* and *contributions* are as recorded, *finals* the recorded final
    weights. Sleeves recorded without a slice are taken to have the mandate's. An empty result
    means the book holds.
    """
    if "slice" not in sleeves.columns:
        sleeves = sleeves.join(strategy_slices(strategies), ["fund", "strategy"], "left")
    return broken_rules(sleeves, contributions, finals, evidence, strategies, funds)


def union_books(contributions: DataFrame, finals: DataFrame) -> DataFrame:
    """Names in either book with the missing side as zero."""
    combined = contributions.groupBy("fund", "date", "ticker").agg(F.sum("contribution").alias("combined"))
    joined = combined.join(finals.select("fund", "date", "ticker", "final"), ["fund", "date", "ticker"], "full")
    return joined.select(
        "fund", "date", "ticker",
        F.coalesce("combined", F.lit(0.0)).alias("combined"), F.coalesce("final", F.lit(0.0)).alias("final"),
    )


def strategy_modes(models: DataFrame, answered: Column) -> DataFrame:
    """Mode implied by the staff's permissions, and whether all of it is judgment-based."""
    return models.groupBy("strategy").agg(
        F.when(F.bool_or(F.col("approach") == "long_short"), "long_short").otherwise("long_only").alias("mode"),
        F.when(F.bool_and(answered), "discretionary").otherwise("systematic").alias("kind"),
    )


def distinct_models(staffing: DataFrame, position: str = "pos") -> DataFrame:
    """Model names of each fund, once, in order of first appearance."""
    return staffing.groupBy("fund", "model_name").agg(F.min(position).alias(position))


def abstention_counts(staffed: DataFrame) -> DataFrame:
    """Signals and abstentions per strategy and date."""
    return staffed.groupBy("fund", "strategy", "date").agg(
        F.count("*").alias("n_signals"), F.count_if(F.col("abstained")).alias("n_abstained")
    )
