"""Rules a recorded book must keep, checked at all its levels in one aggregate.

Records, evidence, contributions and final weights are put into one long table, which is added up by name. Strategy, final
name and fund are sums of names, and a list of rules, each with the level it is read at, is evaluated on the sums: rows
that break none go first. Mandates and limits hold a few rows per fund.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .checks import finite

TOLERANCE = 1e-9
LEVELS = {
    "name": ["fund", "strategy", "date", "ticker"],
    "strategy": ["fund", "strategy", "date"],
    "final": ["fund", "date", "ticker"],
    "fund": ["fund", "date"],
}
VALUES = ("score", "slice", "proof", "target", "contribution", "final")


@dataclass(frozen=True)
class Rule:
    """What is wrong, at which level it shows, and the two figures a reader wants to see."""

    name: str
    level: str
    broken: Column
    observed: Column
    bound: Column


def _weight_rules(label: str, limit: Column) -> list[Rule]:
    """Rules that recorded targets and final contributions share."""
    w, gross, mode = F.col(label), F.col(f"{label}_gross"), F.col("mode")
    there, number, zero = F.col(f"n_{label}") > 0, finite(w), F.lit(0.0)
    sized = there & finite(gross)
    return [
        Rule(f"{label} of a strategy outside the mandate", "name", there & mode.isNull(), w, F.lit(None)),
        Rule(f"{label} not finite", "name", there & ~number, w, F.lit(None)),
        Rule(f"long-only {label} negative", "name", there & number & (mode == "long_only") & (w < -TOLERANCE), w, zero),
        Rule(f"negative {label} without short evidence", "name",
             there & number & (w < -TOLERANCE) & (F.coalesce("proof", zero) >= 0), w, zero),
        Rule(f"flat strategy with {label}", "name",
             there & number & (F.col("flat") > 0) & (F.abs(w) > TOLERANCE), w, zero),
        Rule(f"{label} gross not finite", "strategy", there & ~finite(gross), gross, limit),
        Rule(f"{label} exceeds gross target", "strategy", sized & (gross > limit + TOLERANCE), gross, limit),
        Rule(f"{label} not dollar-neutral", "strategy", sized & (mode == "dollar_neutral") & (F.abs(w) > TOLERANCE), w, zero),
    ]


def rules() -> list[Rule]:
    """All rules on the sums of ``levels``."""
    score, proof, none = F.col("score"), F.col("proof"), F.lit(None)
    scored, proven = F.col("n_score") > 0, F.col("n_proof") > 0
    slice_, share = F.col("slice"), F.col("share")
    final, combined = F.coalesce("final", F.lit(0.0)), F.coalesce("contribution", F.lit(0.0))
    numbers = finite(final) & finite(combined)
    cap, gross, limit = F.col("max_position_pct"), F.coalesce("final_gross", F.lit(0.0)), F.col("max_gross_exposure")
    return [
        Rule("score without evidence", "name", scored & ~proven, score, none),
        Rule("evidence without score", "name", proven & ~scored, none, proof),
        Rule("score not finite", "name", scored & ~finite(score), score, proof),
        Rule("score does not match evidence", "name", scored & proven & finite(score) & (F.abs(score - proof) > TOLERANCE), score, proof),
        *_weight_rules("target", F.col("gross_target")),
        *_weight_rules("contribution", F.col("gross_target") * share),
        Rule("strategy outside the mandate", "strategy", scored & F.col("mode").isNull(), none, none),
        Rule("strategy has no record", "strategy", proven & ~scored, none, none),
        Rule("slice does not match the mandate", "strategy",
             scored & F.col("mode").isNotNull() & ~(finite(slice_) & (slice_ > 0) & F.coalesce(F.abs(slice_ - share) <= TOLERANCE, F.lit(False))),
             slice_, share),
        Rule("final weight or contribution not finite", "final", ~numbers, final, combined),
        Rule("contributions do not sum to final", "final", numbers & (F.abs(final - combined) > TOLERANCE), final, combined),
        Rule("final exceeds position cap", "final", finite(final) & (F.abs(final) > cap + TOLERANCE), final, cap),
        Rule("fund has no limits", "fund", cap.isNull() | limit.isNull(), gross, none),
        Rule("final gross not finite", "fund", ~finite(gross), gross, limit),
        Rule("final exceeds gross cap", "fund", finite(gross) & (gross > limit + TOLERANCE), gross, limit),
    ]


def _mandate(strategies: DataFrame) -> DataFrame:
    """Each strategy with its share of the fund's capital; null where the allocations have no positive total."""
    allocated = strategies.groupBy("fund").agg(F.sum("weight").alias("allocated"))
    share = F.when(finite(F.col("allocated")) & (F.col("allocated") > 0), F.col("weight") / F.col("allocated"))
    return strategies.join(allocated, "fund").withColumn("share", share)


def levels(
    records: DataFrame, contributions: DataFrame, finals: DataFrame, evidence: DataFrame, mandate: DataFrame,
) -> dict[str, DataFrame]:
    """For every level one row per group, with sums, gross sums and counts of what it holds.

    Names are added up first, by numbers only, so that they stay in hash aggregation; the levels above are sums of names.
    """
    none = F.lit(None).cast("double")

    def facts(df: DataFrame, flat: Column | None = None, **given: Column) -> DataFrame:
        strategy = F.col("strategy") if "strategy" in df.columns else F.lit(None).cast("string")
        return df.select(
            "fund", strategy.alias("strategy"), "date", "ticker",
            *[given.get(v, none).cast("double").alias(v) for v in VALUES],
            *[F.lit(int(v in given)).alias(f"has_{v}") for v in VALUES],
            (F.lit(0) if flat is None else flat.isNotNull().cast("int")).alias("flat"),
        )

    long = (
        facts(records, score=F.col("score"), target=F.col("weight"), slice=F.col("slice"))
        .unionByName(facts(evidence, F.col("flat_reason"), proof=F.col("score")))
        .unionByName(facts(contributions, contribution=F.col("contribution")))
        .unionByName(facts(finals, final=F.col("final")))
    )
    of_names, of_sums = {}, {}
    for v in VALUES:
        largest = v in ("score", "slice", "proof")
        of_names[f"n_{v}"], of_names[v] = F.sum(f"has_{v}"), F.max(v) if largest else F.sum(v)
        of_sums[f"n_{v}"], of_sums[v] = F.sum(f"n_{v}"), F.max(v) if largest else F.sum(v)
    for v in ("target", "contribution", "final"):
        of_names[f"{v}_gross"], of_sums[f"{v}_gross"] = F.sum(F.abs(v)), F.sum(f"{v}_gross")
    of_names["flat"] = of_sums["flat"] = F.max("flat")
    keys = LEVELS["name"]
    names = stored(long.groupBy(*keys).agg(*[c.alias(n) for n, c in of_names.items()]), "names")
    terms = mandate.groupBy("fund", "strategy").agg(*[F.max(c).alias(c) for c in ("mode", "gross_target", "share")])
    found = {}
    for level, by in LEVELS.items():
        sums = names if level == "name" else names.groupBy(*by).agg(*[c.alias(n) for n, c in of_sums.items()])
        if "strategy" in by:
            sums = sums.where("strategy IS NOT NULL").join(terms, ["fund", "strategy"], "left")  # rows of final weights have no strategy
        found[level] = sums
    return found


def broken_rules(
    records: DataFrame, contributions: DataFrame, finals: DataFrame, evidence: DataFrame, strategies: DataFrame, funds: DataFrame,
) -> DataFrame:
    """Every broken rule as (rule, fund, strategy, date, ticker, observed, bound); empty means the book holds.

    *records* are the recorded sleeves (score, weight, slice), *evidence* the sleeves worked out anew
    from the signals (score, flat_reason), *finals* the recorded final weights. A fund without limits, a
    strategy with evidence and no record and an allocation without a positive total are violations, not omissions.
    """
    mandate = _mandate(strategies)
    limits = funds.select("fund", "max_position_pct", "max_gross_exposure")
    out = None
    for level, sums in levels(records, contributions, finals, evidence, mandate).items():
        here = [r for r in rules() if r.level == level]
        broken = [F.coalesce(r.broken, F.lit(False)) for r in here]
        hits = [
            F.when(b, F.struct(F.lit(r.name).alias("rule"), r.observed.cast("double").alias("observed"), r.bound.cast("double").alias("bound")))
            for r, b in zip(here, broken, strict=True)
        ]
        keys = [(F.col(k) if k in LEVELS[level] else F.lit(None).cast("string")).alias(k) for k in ("fund", "strategy", "date", "ticker")]
        rows = sums.join(limits, "fund", "left").where(reduce(or_, broken))
        rows = rows.select(*keys, F.explode(F.array_compact(F.array(*hits))).alias("h"))
        rows = rows.select("h.rule", "fund", "strategy", "date", "ticker", "h.observed", "h.bound")
        out = rows if out is None else out.unionByName(rows)
    none = F.lit(None).cast("string")
    unfunded = mandate.where(F.col("share").isNull()).groupBy("fund").agg(F.max("allocated").alias("observed")).select(
        F.lit("allocations need a finite, positive total").alias("rule"), "fund", none.alias("strategy"), F.lit(None).cast("date").alias("date"),
        none.alias("ticker"), "observed", F.lit(0.0).alias("bound"),
    )
    return out.unionByName(unfunded)
