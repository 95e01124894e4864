"""Signals as panels over (ticker, date), and the registry of signal models."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .asof import carry_forward
from .checks import finite
from .eventstudy import drop_retrospective
from .keyed import pick_per_key

# Preferred source of a period's surprise, lower is better.
SOURCE_PRIORITY = {"8-K": 0, "10-Q": 1, "10-K": 2, "20-F": 3}
OTHER_SOURCE = 99
SIGNAL_DAYS = 4
MAX_MODELS = 10_000


def labeled_only(filings: DataFrame, labels: tuple[str, ...] = ("BEAT", "MISS"), announcement_only: bool = False) -> DataFrame:
    """Filings with one of the labels, optionally announcements (8-K) only."""
    kept = filings.where(F.col("eps_surprise").isin(*labels))
    return kept.where(F.col("source_type") == "8-K") if announcement_only else kept


def conviction_filter(signals: DataFrame, threshold: float = 0.0, value: str = "value") -> DataFrame:
    """Signals strictly beyond the threshold, with their direction; a value that is no number never acts."""
    acted = signals.where(finite(F.col(value)) & (F.abs(value) > threshold))
    return acted.withColumn("direction", F.when(F.col(value) > 0, "long").otherwise("short"))


def source_rank(source: Column) -> Column:
    rank = F.lit(OTHER_SOURCE)
    for name, place in SOURCE_PRIORITY.items():
        rank = F.when(source == name, place).otherwise(rank)
    return rank


def best_filing_per_period(filings: DataFrame) -> DataFrame:
    """One filing per (ticker, report period): best source, then earliest."""
    filings = filings.where(F.col("filing_date").isNotNull())  # an undated filing was never known
    order = [source_rank(F.col("source_type")), F.col("filing_date"), F.col("filing_id")]
    return pick_per_key(filings, ["ticker", "report_period"], order, last=False)


def qualifying_surprises(filings: DataFrame, *, announcement_only: bool = True) -> DataFrame:
    """Timely BEAT/MISS filings that were the best of their period when they were made.

    With announcements only that is one filing per period, the earliest. With
    the fallback sources a period may first be known from a lesser source and
    later from a better one; each counts from its own day, so nothing later
    changes what was known. At most one filing per source rank is compared.
    """
    usable = drop_retrospective(labeled_only(filings, announcement_only=announcement_only))
    if announcement_only:
        return best_filing_per_period(usable)
    ranked = usable.withColumn("_rank", source_rank(F.col("source_type")))
    earliest = pick_per_key(
        ranked, ["ticker", "report_period", "_rank"], [F.col("filing_date"), F.col("filing_id")], last=False
    )
    before = (
        Window.partitionBy("ticker", "report_period").orderBy("filing_date", "_rank")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    improved = earliest.withColumn("_best", F.min("_rank").over(before)).where("_best IS NULL OR _rank < _best")
    return improved.drop("_rank", "_best")


def surprise_signal(
    grid: DataFrame, filings: DataFrame, *, signal_days: int = SIGNAL_DAYS, announcement_only: bool = True
) -> DataFrame:
    """+1 after a beat, -1 after a miss, while the latest surprise is fresh; else 0.

    *grid* is (ticker, date). Several periods filed on one day keep the newest
    period (then the lowest id), so the join meets at most one event per cell.
    """
    events = qualifying_surprises(filings, announcement_only=announcement_only)
    per_day = pick_per_key(
        events.select("ticker", "filing_date", "report_period", "filing_id", "source_type", "eps_surprise"),
        ["ticker", "filing_date"], [F.col("report_period"), -F.col("filing_id")],
    )
    fresh = carry_forward(per_day, ["ticker"], "filing_date", tolerance=signal_days, as_of="date")
    value = (
        F.when(F.col("eps_surprise") == "BEAT", 1.0).when(F.col("eps_surprise") == "MISS", -1.0).otherwise(0.0)
    )
    joined = grid.join(fresh, ["ticker", "date"], "left")
    return joined.select(
        F.lit("pead").alias("model_name"), "ticker", "date", value.alias("value"),
        F.lit(False).alias("abstained"), "eps_surprise", "source_type", "report_period", "filing_date",
    )


def request_grid(cells: DataFrame, models: DataFrame) -> DataFrame:
    """Every (ticker, date) cell asked of every model of the mandate.

    The mandate's models, a handful, come in as one array and unfold each cell; more
    than MAX_MODELS of them are an error.
    """
    found = F.collect_list(F.struct(*models.columns))
    few = F.when(F.count("*") > MAX_MODELS, F.raise_error(F.lit("too many models for one mandate"))).otherwise(found)
    listed = models.agg(few).scalar()
    asked = cells.withColumn("_models", listed).withColumn("_m", F.explode("_models"))
    return asked.select(*cells.columns, "_m.*")


SIGNAL_COLUMNS = ("model_name", "ticker", "date", "value", "abstained", "reason")


@dataclass(frozen=True)
class SignalModel:
    """A named function (grid, tables) -> signals, with its permission to short."""

    name: str
    approach: str
    build: Callable[[DataFrame, Mapping[str, DataFrame]], DataFrame]

    def __post_init__(self):
        if self.approach not in ("long_only", "long_short"):
            raise ValueError(f"model {self.name!r}: approach must be long_only or long_short")

    def __call__(self, grid: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
        out = self.build(grid, tables)
        missing = set(SIGNAL_COLUMNS) - set(out.columns)
        if missing:
            raise ValueError(f"model {self.name!r} did not return {sorted(missing)}")
        return out.select(*SIGNAL_COLUMNS)


REGISTRY: dict[str, SignalModel] = {}


def register(model: SignalModel) -> SignalModel:
    REGISTRY[model.name] = model
    return model


def _surprise_with_reason(grid: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    found = surprise_signal(grid, tables["filings"])
    return found.withColumn("reason", F.coalesce(F.concat_ws(" ", "eps_surprise", "source_type"), F.lit("")))


register(SignalModel("pead", "long_short", _surprise_with_reason))


def answered_model(name: str, approach: str) -> SignalModel:
    """A model whose answers arrive as a table keyed by (ticker, date)."""

    def build(grid: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
        answers = tables[name]
        said = F.col("reason") if "reason" in answers.columns else F.lit(None).cast("string")
        answers = answers.select("ticker", "date", "value", "abstained", said.alias("reason"))
        return grid.join(answers, ["ticker", "date"], "left").select(
            F.lit(name).alias("model_name"), "ticker", "date",
            F.coalesce("value", F.lit(0.0)).alias("value"),
            F.coalesce("abstained", F.lit(True)).alias("abstained"),
            F.coalesce("reason", F.when(F.col("abstained").isNull(), "no answer").otherwise("")).alias("reason"),
        )

    return SignalModel(name, approach, build)


def approaches(spark: SparkSession, names: list[str]) -> DataFrame:
    """(model_name, approach) of registered models, for the vote weights of a mandate."""
    return spark.createDataFrame([(n, REGISTRY[n].approach) for n in names], "model_name string, approach string")


def run_models(names: list[str], grid: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Signals of several registered models over one grid."""
    unknown = [n for n in names if n not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown models: {unknown}")
    panels = [REGISTRY[n](grid, tables) for n in names]
    out = panels[0]
    for panel in panels[1:]:
        out = out.unionByName(panel)
    return out


def signals_by_key(signals: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Signals of a (ticker, date) as one map by model, with their mean.

    One entry per model, so the collected list is as short as the model list.
    """
    return signals.groupBy("ticker", "date").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_name", "value")))).alias("signals"),
        F.avg("value").alias("composite_score"),
    )
