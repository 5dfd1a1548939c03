"""Daily means and the joins that build the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import nan_to_null
from tidemark.series import SERIES, Series


def daily_mean(ticks: DataFrame, values: tuple[str, ...] = ("Close", "Volume"), series: Series = SERIES) -> DataFrame:
    """Mean of each value by day and key: one row per day, whatever the number of ticks."""
    means = [F.avg(nan_to_null(F.col(v).cast("double"))).alias(v) for v in values]
    return ticks.groupBy(series.date, series.key).agg(*means)


def daily_sentiment(scored: DataFrame, sentiment: str = "sentiment", series: Series = SERIES) -> DataFrame:
    """Mean score by day and key."""
    return scored.groupBy(series.date, series.key).agg(F.avg(sentiment).alias(sentiment))


def attach_sentiment(
    panel: DataFrame, scored: DataFrame, drive: str = "panel", sentiment: str = "sentiment", series: Series = SERIES
) -> DataFrame:
    """Join daily sentiment to the panel.

    ``drive='panel'`` keeps every panel day (0 where nothing was said); ``drive='tweets'`` keeps
    only days with text, with NULL prices outside the panel. Texts are averaged before the join,
    so several texts on a day never multiply the price rows.
    """
    daily = daily_sentiment(scored, sentiment, series)
    on = [series.date, series.key]
    if drive == "panel":
        joined = panel.join(daily, on, "left")
    elif drive == "tweets":
        joined = daily.join(panel, on, "left")
    else:
        raise ValueError(f"unknown drive {drive!r}")
    return joined.na.fill({sentiment: 0.0})


def attach_benchmark(
    panel: DataFrame, benchmark: DataFrame, price: str = "Close", out: str = "Benchmark_Close", date: str = "Date"
) -> DataFrame:
    """Put the benchmark price of the day beside every panel row.

    The benchmark has one row per day, so its size is bounded by the calendar and it may be
    broadcast: all years 1 to 9999 hold fewer than 3.7 million days.
    """
    days = benchmark.groupBy(date).agg(F.avg(price).alias(out))
    return panel.join(days, date, "left")
