"""Constant and median fills."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import attach_per_key
from tidemark.operators.statistics import lower_median
from tidemark.series import SERIES, Series
from tidemark.session import written


def filter_keys(df: DataFrame, keys: list[str] | DataFrame, key: str = "Ticker") -> DataFrame:
    """Rows whose key is listed (case matters, NULL keys go); a long list may be a DataFrame."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key), key, "left_semi")
    return df.where(F.col(key).isin(keys))


def fill_const(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.na.fill(values)


def fill_residual(
    df: DataFrame,
    scope: str = "global",
    price: str = "Close",
    volume: str = "Volume",
    series: Series = SERIES,
) -> DataFrame:
    """Fill what is still NULL: the price by its lower median (``global``, per ``key``, ``none``), volume by 0.

    The median is exact. As finding it takes several readings, ``df`` is written to the shared folder first.
    """
    if scope == "none":
        return df.withColumn(volume, F.coalesce(F.col(volume), F.lit(0)))
    if scope not in ("global", "key"):
        raise ValueError(f"unknown scope {scope!r}")
    df = written(df, "unfilled")
    out = df.withColumn(volume, F.coalesce(F.col(volume), F.lit(0)))
    if scope == "global":
        return out.withColumn(price, F.coalesce(F.col(price), lower_median(df, price, stored=True).scalar()))
    per_key = lower_median(df, price, series.key, stored=True).withColumnRenamed("median", "_median")
    return (
        attach_per_key(out, per_key, series)
        .withColumn(price, F.coalesce(F.col(price), F.col("_median")))
        .drop("_median")
    )
