"""The driver tables seen as bars, filings, metrics, signals, marks and fills."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import pick_per_key
from ..session import configure

# Small literal tables, written once and read by both engines.
MODEL_CFG = """(VALUES
  ('alpha','click',1.0D,'long_short'), ('alpha','view',1.0D,'long_only'), ('alpha','purchase',2.0D,'long_only'),
  ('beta','error',1.0D,'long_short'), ('beta','signup',1.5D,'long_only'))
  AS t(strategy, model_name, weight, approach)"""
STRATEGY_CFG = """(VALUES
  ('core','alpha',0.6D,'long_only',1.0D), ('core','beta',0.4D,'long_short',1.0D),
  ('neutral','alpha',0.6D,'dollar_neutral',1.6D), ('neutral','beta',0.4D,'long_short',1.0D))
  AS t(fund, strategy, weight, mode, gross_target)"""
FUND_CFG = """(VALUES
  ('core',100000.0D,0.0213D,0.7871D), ('neutral',250000.0D,0.0213D,0.9173D))
  AS t(fund, capital, max_position_pct, max_gross_exposure)"""


# Declared schemas: no footer is opened to plan a query.
SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def duck(values: str) -> str:
    """The same literal table in the other dialect (no D suffix on doubles)."""
    import re

    return re.sub(r"(\d\.\d+)D", r"\1::DOUBLE", values)


def cents(amount: Column | str) -> Column:
    """A two-decimal amount as a whole number: sums stay exact and cheap, unlike decimals built from doubles."""
    return F.rint((F.col(amount) if isinstance(amount, str) else amount) * 100).cast("bigint")


def price_of(paid: str, units: str) -> Column:
    """Average price from exact sums of cents and hundredths of units."""
    return (F.col(paid).cast("double") / 100) / (F.col(units).cast("double") / 100)


class Dataset:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def literal(self, values: str) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM {values}")

    @cached_property
    def n_tickers(self) -> Column:
        return self.table("supplier").agg(F.count("*")).scalar()

    @cached_property
    def _daily_sums(self) -> DataFrame:
        """Exact day sums per ticker."""
        return (
            self.table("lineitem")
            .groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("d"))
            .agg(
                F.sum(cents("l_extendedprice")).alias("paid"),
                F.sum(cents("l_quantity")).alias("units"),
            )
        )

    @staticmethod
    def _ticker(key: Column | str) -> Column:
        return F.concat(F.lit("S"), F.col(key) if isinstance(key, str) else key)

    @cached_property
    def closes(self) -> DataFrame:
        return self._daily_sums.select(
            self._ticker("l_suppkey").alias("ticker"), "d",
            price_of("paid", "units").alias("close"),
        )

    @cached_property
    def market(self) -> DataFrame:
        # Whole numbers, so sums of lines are the sums of the tickers' sums, and only days travel.
        return (
            self.table("lineitem")
            .groupBy(F.col("l_shipdate").cast("date").alias("d"))
            .agg(
                F.sum(cents("l_extendedprice")).alias("paid"),
                F.sum(cents("l_quantity")).alias("units"),
            )
            .select(
                F.lit("MKT").alias("ticker"), "d",
                price_of("paid", "units").alias("close"),
            )
        )

    @cached_property
    def bars(self) -> DataFrame:
        price = F.col("l_extendedprice") / F.col("l_quantity")
        day = (
            self.table("lineitem")
            .groupBy("l_suppkey", F.col("l_shipdate").cast("date").alias("d"))
            .agg(
                F.sum(cents("l_extendedprice")).alias("paid"),
                F.sum(cents("l_quantity")).alias("units"),
                F.max(price).alias("high"),
                F.min(price).alias("low"),
            )
        )
        return day.select(
            self._ticker("l_suppkey").alias("ticker"), "d",
            price_of("paid", "units").alias("close"),
            "high", "low", F.round(F.col("units") / 100).cast("bigint").alias("volume"),
        )

    @cached_property
    def filings(self) -> DataFrame:
        source = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "8-K")
            .when(F.col("o_orderpriority") == "2-HIGH", "10-Q")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "10-K")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "20-F")
            .otherwise("6-K")
        )
        surprise = (
            F.when(F.col("o_orderstatus") == "O", "BEAT")
            .when(F.col("o_orderstatus") == "F", "MISS")
            .when(F.col("o_orderstatus") == "P", "MEET")
        )
        filed = F.col("o_orderdate").cast("date")
        return self.table("orders").select(
            F.col("o_orderkey").alias("filing_id"),
            self._ticker(F.col("o_custkey") % self.n_tickers).alias("ticker"),
            filed.alias("filing_date"),
            F.date_sub(filed, (F.col("o_orderkey") * 7 % 91).cast("int")).alias("report_period"),
            source.alias("source_type"),
            surprise.alias("eps_surprise"),
        )

    @cached_property
    def metrics(self) -> DataFrame:
        filed = F.col("o_orderdate").cast("date")
        joined = self.table("orders").join(
            self.table("customer").select("c_custkey", "c_acctbal"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        return joined.select(
            F.col("o_orderkey").alias("filing_id"),
            self._ticker(F.col("o_custkey") % self.n_tickers).alias("ticker"),
            filed.alias("filing_date"),
            F.date_sub(filed, (F.col("o_orderkey") * 7 % 91).cast("int")).alias("report_period"),
            F.lit("ttm").alias("period"),
            (F.col("o_totalprice") * 1000).alias("market_cap"),
            F.when(F.col("o_orderkey") % 11 != 0, F.col("c_acctbal") / 10000).alias("return_on_equity"),
            ((F.col("o_orderkey") % 100) / 100).alias("net_margin"),
            ((F.col("o_custkey") % 100) / 100).alias("gross_margin"),
            (F.col("o_totalprice") / 1000).alias("book_value_per_share"),
            ((F.col("o_orderkey") % 30) / 10).alias("debt_to_equity"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                self._ticker("s_suppkey").alias("ticker"), F.col("s_name").alias("name"),
                F.col("r_name").alias("sector"), F.col("n_name").alias("industry"),
            )
        )

    @cached_property
    def news(self) -> DataFrame:
        return self.table("documents").select(
            "doc_id",
            self._ticker(F.col("doc_id") % self.n_tickers).alias("ticker"),
            F.substring_index("text", "\n", 1).alias("title"),
            "text",
            "source",
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("date"),
        )

    @cached_property
    def insider(self) -> DataFrame:
        lines = self.table("lineitem").groupBy("l_orderkey", "l_suppkey").agg(
            F.sum(cents("l_quantity")).alias("shares"),
            F.sum(cents("l_extendedprice")).alias("value"),
        )
        orders = self.table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("filing_date"))
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            self._ticker("l_suppkey").alias("ticker"), "filing_date", F.col("l_orderkey").alias("order_id"),
            (F.col("shares").cast("double") / 100).alias("transaction_shares"),
            (F.col("value").cast("double") / 100).alias("transaction_value"),
        )

    @cached_property
    def signals(self) -> DataFrame:
        """Latest event per (ticker, date, model) as a signal."""
        raw = self.table("events").select(
            F.concat(F.lit("U"), F.col("user_id")).alias("ticker"),
            F.col("ts").cast("date").alias("date"),
            F.col("event_type").alias("model_name"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            "event_id",
        )
        last = pick_per_key(raw, ["ticker", "date", "model_name"], [F.col("event_id")])
        return last.select(
            "ticker", "date", "model_name", "k",
            ((F.col("k") - 50) / 50).alias("value"), (F.col("k") % 10 == 0).alias("abstained"),
        )

    @cached_property
    def marks(self) -> DataFrame:
        """Last event value of each (ticker, day), shifted to stay positive."""
        raw = self.table("events").select(
            F.concat(F.lit("U"), F.col("user_id")).alias("ticker"),
            F.col("ts").cast("date").alias("d"),
            "event_id", (F.col("value") + 10).alias("close"),
        )
        return raw.groupBy("ticker", "d").agg(F.max_by("close", "event_id").alias("close"))

    @cached_property
    def fills(self) -> DataFrame:
        buys = F.col("o_orderkey") % 2 == 0
        return self.table("orders").select(
            F.concat(F.lit("F"), F.col("o_custkey") % 10).alias("fund"),
            self._ticker(F.col("o_custkey") % self.n_tickers).alias("ticker"),
            F.col("o_orderdate").cast("date").alias("session"),
            F.col("o_orderkey").alias("seq"),
            F.when(buys, "buy").otherwise("sell").alias("side"),
            (F.col("o_orderkey") % 100 + 1).alias("quantity"),
            (F.col("o_totalprice").cast("decimal(18,2)") / 1000).cast("decimal(18,5)").alias("price"),
        )

    @cached_property
    def answers(self) -> DataFrame:
        """Model answers as free text: fenced, in prose, bare, some cut short."""
        word = (
            F.when(F.col("event_type") == "click", "bullish")
            .when(F.col("event_type") == "view", "bearish")
            .when(F.col("event_type") == "purchase", "neutral")
            .otherwise("invalid")
        )
        body = F.concat(
            F.lit('{"signal": "'), word, F.lit('", "confidence": '), F.get_json_object("props", "$.k"),
            F.lit(', "reasoning": "e'), F.col("event_id"), F.lit('"}'),
        )
        wrapped = (
            F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(F.col("event_id") % 3 == 1, F.concat(F.lit("My view {as of now}: "), body, F.lit(" Thanks.")))
            .otherwise(body)
        )
        text = F.when(F.col("event_id") % 7 == 0, F.substring(wrapped, 1, 30)).otherwise(wrapped)
        return self.table("events").select("event_id", "event_type", text.alias("text"))

    @cached_property
    def models(self) -> DataFrame:
        return self.literal(MODEL_CFG)

    @cached_property
    def strategies(self) -> DataFrame:
        return self.literal(STRATEGY_CFG)

    @cached_property
    def funds(self) -> DataFrame:
        return self.literal(FUND_CFG)
