"""The given test tables read as market data.

Orders are ticks: the day of the order, its priority as key, its total as price, volume 1 each.
Documents are texts: spread over days and keys by their id, three texts per day and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_date
from tidemark.operators.calendar import densify, first_and_last_day
from tidemark.plans.panels import filled_panel

# The keys and the first day of the order table, and the spread of the texts.
KEYS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FIRST_DAY = "1995-01-01"
TEXT_DAYS = 2405
TEXTS_PER_DAY = 3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("Date"),
        F.col("o_orderpriority").alias("Ticker"),
        F.col("o_totalprice").alias("Close"),
        F.lit(1).cast("bigint").alias("Volume"),
    )


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks with a volume of their own: one to a hundred, by the customer's number."""
    return table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("Date"),
        F.col("o_orderpriority").alias("Ticker"),
        F.col("o_totalprice").alias("Close"),
        (F.col("o_custkey") % 100 + 1).alias("Volume"),
    )


def gappy_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Trades with every third price unknown, all of the first two years among them."""
    known = (F.col("o_orderkey") % 3 > 0) & (F.year("o_orderdate") > 1996)
    return table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("Date"),
        F.col("o_orderpriority").alias("Ticker"),
        F.when(known, F.col("o_totalprice")).alias("Close"),
        (F.col("o_custkey") % 100 + 1).alias("Volume"),
    )


def daily(rows: DataFrame) -> DataFrame:
    """Daily mean price, and total volume: the number of ticks."""
    return rows.groupBy("Date", "Ticker").agg(
        F.avg("Close").alias("Close"), F.sum("Volume").cast("double").alias("Volume")
    )


def prices(spark: SparkSession, folder: str) -> DataFrame:
    return daily(ticks(spark, folder))


def shipped(spark: SparkSession, folder: str) -> DataFrame:
    """What suppliers ship; the key is their number, which is shorter than its text in all sorting and grouping."""
    return table(spark, folder, "lineitem").select(
        F.to_date("l_shipdate").alias("Date"), F.col("l_suppkey").alias("Ticker"), "l_extendedprice", "l_quantity"
    )


def supplier_days(spark: SparkSession, folder: str) -> DataFrame:
    """A wider panel: mean price and quantity by supplier and shipping day."""
    return shipped(spark, folder).groupBy("Date", "Ticker").agg(F.avg("l_extendedprice").alias("Close"), F.sum("l_quantity").alias("Volume"))


def supplier_prices(spark: SparkSession, folder: str) -> DataFrame:
    """``supplier_days`` with the key as text."""
    return supplier_days(spark, folder).withColumn("Ticker", F.col("Ticker").cast("string"))


def dense(spark: SparkSession, folder: str) -> DataFrame:
    """Prices on every day of every key, carried forward; leading days stay NULL."""
    rows = ticks(spark, folder)
    return densify(daily(rows), span=first_and_last_day(rows))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """The dense panel with nothing NULL."""
    rows = ticks(spark, folder)
    return filled_panel(daily(rows), span=first_and_last_day(rows))


def tweets(spark: SparkSession, folder: str) -> DataFrame:
    key = F.element_at(F.array(*[F.lit(k) for k in KEYS]), (F.pmod("doc_id", F.lit(len(KEYS))) + 1).cast("int"))
    day = F.pmod(F.floor(F.col("doc_id") / (len(KEYS) * TEXTS_PER_DAY)), F.lit(TEXT_DAYS)).cast("int")
    written = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), day), "dd/MM/yyyy")
    return table(spark, folder, "documents").select(
        "doc_id", written.alias("date"), key.alias("stock_name"), F.col("text").alias("tweet")
    )


def parsed_tweets(spark: SparkSession, folder: str) -> DataFrame:
    return tweets(spark, folder).select(
        "doc_id", parse_date("date", dayfirst=True).alias("Date"), F.col("stock_name").alias("Ticker"), "tweet"
    )


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    """Mean price of the day over all keys, on every day."""
    rows = ticks(spark, folder)
    means = rows.groupBy("Date").agg(F.avg("Close").alias("Close")).withColumn("Ticker", F.lit("ALL"))
    return densify(means, values=("Close",), span=first_and_last_day(rows)).drop("Ticker")
