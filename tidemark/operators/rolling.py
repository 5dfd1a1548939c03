"""Row-based window columns. A value appears only once its window is full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numbers import as_column, ratio
from tidemark.operators.blocks import BLOCK, day_number, known_rows, over_blocks, whole_div
from tidemark.series import SERIES, Series


def known(c: str | Column, n: int, w: WindowSpec) -> Column:
    """How many of the last ``n`` values are known: by two counts that grow with the rows, as a moving frame is read anew for each row."""
    column = as_column(c)
    return F.count(column).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.count(column).over(w.rowsBetween(Window.unboundedPreceding, -n))


def with_earlier(part: str, n: int, size: int, w: WindowSpec) -> list[Column]:
    """The parts of a frame of ``n`` rows: ``part`` was made over the last ``size`` rows, the others are the ``part`` of earlier rows.

    Where ``size`` doesn't divide ``n``, the last two parts overlap.
    """
    return [F.col(part), *[shift(part, min(k, n - size), w) for k in range(size, n, size)]]


def when_full(make: Callable[[Column], Column], c: str | Column, n: int, w: WindowSpec) -> Column:
    return F.when(known(c, n, w) == n, make(as_column(c)).over(w.rowsBetween(-(n - 1), 0)))


def rolling_mean(c: str | Column, n: int, w: WindowSpec) -> Column:
    return when_full(F.avg, c, n, w)


def rolling_std(c: str | Column, n: int, w: WindowSpec) -> Column:
    return when_full(F.stddev_samp, c, n, w)


def rolling_min(c: str | Column, n: int, w: WindowSpec) -> Column:
    return when_full(F.min, c, n, w)


def rolling_max(c: str | Column, n: int, w: WindowSpec) -> Column:
    return when_full(F.max, c, n, w)


def shift(c: str | Column, k: int, w: WindowSpec) -> Column:
    return F.lag(as_column(c), k).over(w)


def diff(c: str | Column, w: WindowSpec, k: int = 1) -> Column:
    return as_column(c) - shift(c, k, w)


def pct_change(c: str | Column, w: WindowSpec) -> Column:
    return ratio(c, shift(c, 1, w)) - 1


def last_n(df: DataFrame, n: int, series: Series = SERIES) -> DataFrame:
    """The newest ``n`` rows of each series, with ``step`` 1..n in time order.

    Each block first keeps its own newest ``n``, so at most ``n`` rows per block meet per key.
    """
    rows = known_rows(df, series).withColumn(BLOCK, whole_div(day_number(series), series.block_rows))
    newest_in_block = Window.partitionBy(series.key, BLOCK).orderBy(F.desc(series.date))
    newest = Window.partitionBy(series.key).orderBy(F.desc(series.date))
    kept = rows.withColumn("_rank", F.row_number().over(newest_in_block)).where(F.col("_rank") <= n)
    kept = kept.drop("_rank", BLOCK).withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= n)
    in_order = Window.partitionBy(series.key).orderBy(series.date)
    return kept.drop("_rank").withColumn("step", F.row_number().over(in_order))


def add_rolling(
    df: DataFrame, c: str, n: int, kind: str = "mean", out: str | None = None, series: Series = SERIES
) -> DataFrame:
    """One rolling statistic (mean, std, min or max) of ``c`` over ``n`` rows."""
    make = {"mean": rolling_mean, "std": rolling_std, "min": rolling_min, "max": rolling_max}[kind]
    return over_blocks(df, n - 1, lambda w: {out or f"{c}_{kind}_{n}": make(c, n, w)}, series=series)
