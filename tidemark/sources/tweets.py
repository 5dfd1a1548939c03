from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import parse_date
from tidemark.operators.filling import filter_keys


def read_tweets(spark: SparkSession, path: str, keys: list[str] | None = None, multiline: bool = False) -> DataFrame:
    """Texts as (Date, Ticker, tweet), read as strings; dates are day first.

    ``multiline`` allows line breaks inside quoted texts, at the price of one task per file.
    """
    rows = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
        .select(parse_date("date", dayfirst=True).alias("Date"), F.col("stock_name").alias("Ticker"), "tweet")
    )
    return rows if keys is None else filter_keys(rows, keys)
