"""From prices and texts to one panel by day and key; nothing collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.aggregates import attach_sentiment, daily_mean
from tidemark.operators.calendar import densify, first_and_last_day, spread_days, stretch
from tidemark.operators.filling import fill_residual, filter_keys
from tidemark.operators.sentiment import lexicon_score
from tidemark.operators.statistics import Measure, middle, ranked_values
from tidemark.series import SERIES, Series
from tidemark.session import written


def score_tweets(tweets: DataFrame, keys: list[str] | None, lexicon: DataFrame | None, negation: bool, id: str | None, series: Series) -> DataFrame:
    chosen = tweets if keys is None else filter_keys(tweets, keys, series.key)
    return lexicon_score(chosen, "tweet", id, lexicon, negation, keep=(series.date, series.key))


def dense_prices(
    prices: DataFrame,
    keys: list[str] | None = None,
    scope: str = "global",
    series: Series = SERIES,
) -> DataFrame:
    """Daily prices of every key with no day missing and nothing NULL (``scope`` 'none' keeps NULLs).

    Known values are carried forward; what has no earlier value takes the median price and volume
    0, once for observed days without a price and once for days before a key's first.
    """
    chosen = prices if keys is None else filter_keys(prices, keys, series.key)
    span = first_and_last_day(chosen, series.date)
    return filled_panel(daily_mean(chosen, series=series), keys, scope, span, series)


def filled_panel(
    daily: DataFrame, keys: list[str] | None = None, scope: str = "global", span: tuple[Column, Column] | None = None, series: Series = SERIES
) -> DataFrame:
    """``dense_prices`` of a table with one row per day and key.

    The stretched rows are written once, for the medians and the panel to share; both medians come from the same readings of it.
    """
    if scope != "global":
        dense = densify(daily, keys=keys, span=span, series=series)
        return dense if scope == "none" else fill_residual(dense, scope, series=series)
    stretched = written(stretch(daily, keys=keys, span=span, series=series), "stretched")
    observed, leading = panel_medians(stretched, series)
    dense = spread_days(stretched, keys=keys, observed_default={"Close": observed, "Volume": F.lit(0.0)}, series=series)
    return dense.withColumns({"Close": F.coalesce("Close", leading), "Volume": F.coalesce("Volume", F.lit(0))})


def panel_medians(stretched: DataFrame, series: Series) -> tuple[Column, Column]:
    """The two medians of a panel: of the observed rows' prices carried forward, and of the days' prices.

    The second is over each price as often as it is carried, and over the first median for the days of observed rows that have
    nothing to carry, ``unknown`` many. Being one value many times, that is the median itself wherever it
    lies between the prices at the middle rank without and with those days below it.
    """
    price, is_row = F.col("Close"), F.col(series.date).isNotNull()
    days = F.when(is_row, F.datediff("_until", series.date))
    found = ranked_values(
        stretched,
        [
            Measure(F.when(is_row, price), lambda n, *_: F.array(middle(n))),
            Measure(price, lambda _, n, unknown: F.array(middle(n + unknown), middle(n + unknown) - unknown), days),
            Measure(F.when(is_row & (price.isNull() | F.isnan(price)), 0.0), weight=days),
        ],
        stored=True,
    )
    n, known, unknown = found.totals
    first = found.at(middle(n))
    last = middle(known + unknown)
    second = F.greatest(F.least(first, found.at(last, 1)), found.at(last - unknown, 1))
    second = F.when(unknown > 0, second).otherwise(found.at(last, 1))
    both = found.frame.select(F.struct(first.alias("observed"), second.alias("days")).alias("both")).scalar()
    return both["observed"], both["days"]


def panel_driven(
    prices: DataFrame,
    tweets: DataFrame,
    keys: list[str] | None = None,
    lexicon: DataFrame | None = None,
    scope: str = "global",
    negation: bool = False,
    tweet_id: str | None = None,
    series: Series = SERIES,
) -> DataFrame:
    """Every day of every key: (Date, Ticker, Close, Volume, sentiment); 0 where nothing was said."""
    panel = dense_prices(prices, keys, scope, series)
    scored = score_tweets(tweets, keys, lexicon, negation, tweet_id, series)
    return attach_sentiment(panel, scored, "panel", series=series)


def tweet_driven(
    prices: DataFrame,
    tweets: DataFrame,
    keys: list[str] | None = None,
    lexicon: DataFrame | None = None,
    negation: bool = False,
    tweet_id: str | None = None,
    series: Series = SERIES,
) -> DataFrame:
    """Only days with texts. Prices are averaged by day first; observed days without a price to carry take the
    median, and days before a key's first row stay NULL."""
    chosen = prices if keys is None else filter_keys(prices, keys, series.key)
    span = first_and_last_day(chosen, series.date)
    stretched = written(stretch(daily_mean(chosen, series=series), keys=keys, span=span, series=series), "stretched")
    defaults = {"Close": panel_medians(stretched, series)[0], "Volume": F.lit(0.0)}
    panel = spread_days(stretched, keys=keys, observed_default=defaults, series=series)
    scored = score_tweets(tweets, keys, lexicon, negation, tweet_id, series)
    return attach_sentiment(panel, scored, "tweets", series=series)
