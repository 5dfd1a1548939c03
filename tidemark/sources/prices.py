from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import nan_to_null

# Columns of a price file.
PRICE_SCHEMA = "Date date, Open double, High double, Low double, Close double, `Adj Close` double, Volume bigint"
PRICES = ["Open", "High", "Low", "Close", "Adj Close"]


def price_files(spark: SparkSession, path: str) -> DataFrame:
    """The price files of a folder as a table (key, path): the key is the file name without ``.csv``. No file is opened."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path")
    except AnalysisException as missing:
        raise ValueError(f"no price data found in {path}") from missing
    return files.select(F.regexp_extract("path", r"([^/]*)\.csv$", 1).alias("key"), "path")


def key_table(spark: SparkSession, keys: list[str] | DataFrame) -> DataFrame:
    """Distinct keys as a table with the column ``key``."""
    if isinstance(keys, DataFrame):
        return keys.select(F.col(keys.columns[0]).alias("key")).distinct()
    return spark.createDataFrame([(key,) for key in keys], "key string").distinct()


def missing_keys(spark: SparkSession, path: str, keys: list[str] | DataFrame) -> DataFrame:
    """The keys that have no price file in the folder."""
    return key_table(spark, keys).join(price_files(spark, path), "key", "left_anti")


def read_prices(spark: SparkSession, path: str, keys: list[str] | DataFrame | None = None, all_columns: bool = False) -> DataFrame:
    """All price files of a folder as one relation; the key is the file name without ``.csv``.

    ``keys``, a list or a table of one column, keeps the named files and passes over keys without one (``missing_keys`` has
    them): the list of files is joined with the keys, and only files that are found are scanned, all in one scan with a
    declared schema. No file at all is an error, and told without opening any.
    """
    if keys is None:
        found = [path]
    else:
        wanted = price_files(spark, path).join(key_table(spark, keys), "key", "left_semi")
        # Names, as the scan would list them on the driver anyway; signs that would match other names are quoted.
        found = [re.sub(r"([\[\]{}*?\\])", r"\\\1", row.path) for row in wanted.select("path").collect()]
    try:
        scan = spark.read.schema(PRICE_SCHEMA).option("header", True).option("pathGlobFilter", "*.csv").csv(found) if found else None
    except AnalysisException as missing:
        raise ValueError(f"no price data found in {path}") from missing
    if scan is None or not scan.inputFiles():
        raise ValueError(f"no price data found in {path}" + ("" if keys is None else " for the given keys"))
    key = F.regexp_replace(F.url_decode("_metadata.file_name"), r"\.csv$", "")
    rows = scan.select("*", key.alias("Ticker")).withColumns({c: nan_to_null(f"`{c}`") for c in PRICES})
    return rows if all_columns else rows.select("Date", "Ticker", "Close", "Volume")


def union_prices(parts: list[DataFrame]) -> DataFrame:
    """Rows of several price relations, matched by column name and widened to common types."""
    if not parts:
        raise ValueError("no price data found")
    return reduce(lambda left, right: left.unionByName(right), parts)
