"""Scaling, feature matrix and look-back windows for models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import ratio
from tidemark.operators.blocks import BLOCK, POS, attach_per_key, lay_out
from tidemark.operators.indicators import MODEL_FEATURES
from tidemark.series import SERIES, Series


def feature_matrix(df: DataFrame, features: list[str] | None = None, keep: list[str] | None = None, series: Series = SERIES) -> DataFrame:
    """Key, date and the model inputs, with undefined values as 0."""
    names = features or MODEL_FEATURES
    ids = [series.date, series.key, *(keep or [])]
    return df.select(*ids, *names).na.fill(0.0, subset=names)


def minmax_stats(df: DataFrame, columns: list[str], fit_until: str | None = None, series: Series = SERIES) -> DataFrame:
    """Smallest and largest value of each column per key: (key, min_c, max_c, ..)."""
    rows = df if fit_until is None else df.where(F.col(series.date) <= F.lit(fit_until).cast("date"))
    return rows.groupBy(series.key).agg(
        *[F.min(c).alias(f"min_{c}") for c in columns], *[F.max(c).alias(f"max_{c}") for c in columns]
    )


def scaled(c: str) -> Column:
    low, high = F.col(f"min_{c}"), F.col(f"max_{c}")
    inside = F.coalesce(ratio(F.col(c) - low, high - low), F.lit(0.0))
    return F.when(F.col(c).isNotNull(), inside)


def minmax_scale(
    df: DataFrame, columns: list[str], fit_until: str | None = None, stats: DataFrame | None = None, series: Series = SERIES
) -> DataFrame:
    """Columns scaled to [0, 1] per key; a constant column becomes 0.

    ``fit_until`` takes the limits from rows up to that date only.
    """
    limits = stats if stats is not None else minmax_stats(df, columns, fit_until, series)
    joined = attach_per_key(df, limits, series)
    return joined.withColumns({c: scaled(c) for c in columns}).select(*df.columns)


def minmax_invert(df: DataFrame, c: str, stats: DataFrame, out: str | None = None, source: str | None = None, series: Series = SERIES) -> DataFrame:
    """Scaled values of ``source`` back to the units of column ``c``, by that column's limits."""
    low, high = F.col(f"min_{c}"), F.col(f"max_{c}")
    limits = stats.select(series.key, f"min_{c}", f"max_{c}")
    joined = attach_per_key(df, limits, series)
    return joined.withColumn(out or c, F.col(source or c) * (high - low) + low).drop(f"min_{c}", f"max_{c}")


def lookback_blocks(df: DataFrame, columns: list[str], target: str, length: int = 60, series: Series = SERIES) -> DataFrame:
    """The rows of each block, and the ``length`` rows before it, as arrays: (key, block, ``_dates``, ``_x``, ``_y``).

    What is shuffled, and may be kept, has each row once, but for those copied into the next block: windows of any length
    share these arrays, and are cut out of them where they are used.
    """
    values = F.array(*[F.col(c).cast("double") for c in columns]).alias("x")
    row = F.struct(F.col(POS), F.col(series.date).alias("date"), values, F.col(target).cast("double").alias("y"))
    laid = lay_out(df, length, series).select(series.key, BLOCK, row.alias("_row"))
    # Windows multiply what follows: with a number of its own, small blocks aren't merged into few tasks.
    laid = laid.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), series.key, BLOCK)
    blocks = laid.groupBy(series.key, BLOCK).agg(F.sort_array(F.collect_list("_row")).alias("_rows")).where(F.size("_rows") > length)
    each = {"_dates": "date", "_x": "x", "_y": "y"}
    return blocks.select(series.key, BLOCK, *[F.col(f"_rows.{field}").alias(name) for name, field in each.items()])


def windows_of(blocks: DataFrame, length: int, series: Series = SERIES) -> DataFrame:
    """(date, key, X, y) from the arrays of ``lookback_blocks``."""

    def window(at: Column) -> Column:
        # Not a slice: that would go through the whole array for each window.
        rows = F.transform(F.sequence(at - length, at - 1), lambda i: F.get("_x", i))
        return F.struct(F.get("_dates", at).alias(series.date), rows.alias("X"), F.get("_y", at).alias("y"))

    every = F.transform(F.sequence(F.lit(length), F.size("_x") - 1), window)
    return blocks.select(series.key, F.inline(every)).select(series.date, series.key, "X", "y")


def lookback(df: DataFrame, columns: list[str], target: str, length: int = 60, series: Series = SERIES) -> DataFrame:
    """Rows with ``X`` = the ``length`` rows before (oldest first) and ``y`` = the target now."""
    return windows_of(lookback_blocks(df, columns, target, length, series), length, series)
