"""Technical and sentiment indicators of all series at once.

Every indicator declares how many earlier rows it looks back at. ``add_indicators`` lays the
rows out once with the largest of these and evaluates all windows there: one shuffle for any
selection. On-balance volume alone adds the small per-block table of a running total.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.numbers import ratio
from tidemark.operators.blocks import BLOCK, HALO, POS, REPEATS, block_window, lay_out, place, so_far, trim, with_carry
from tidemark.operators.ewm import carried_over, chained, combined, ewm_means_over_gaps, local_sums, reach
from tidemark.operators.rolling import diff, known, rolling_mean, rolling_std, shift, when_full, with_earlier
from tidemark.series import SERIES, Series

# Window lengths, spans and levels of the indicators.
SHORT, MIDDLE, LONG = 14, 20, 50
SENTIMENT_SHORT, SENTIMENT_LONG = 7, 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
BAND_WIDTH = 2
OVERBOUGHT, OVERSOLD = 70, 30
PERIODS_PER_YEAR = 252
PART = 5

Windowed = Callable[[WindowSpec, "Inputs"], dict[str, Column]]
Plain = Callable[["Inputs"], dict[str, Column]]


@dataclass(frozen=True)
class Inputs:
    price: str = "Close"
    volume: str = "Volume"
    sentiment: str = "sentiment"
    periods_per_year: int = PERIODS_PER_YEAR


def nothing(*_) -> dict[str, Column]:
    return {}


@dataclass(frozen=True)
class Indicator:
    """``first`` windows read the inputs, ``second`` windows read their results, ``last`` no window."""

    look_back: int
    first: Windowed = nothing
    second: Windowed = nothing
    last: Plain = nothing
    means: dict[str, float] = field(default_factory=dict)
    running: bool = False


def change(w: WindowSpec, i: Inputs) -> dict[str, Column]:
    return {"_change": diff(i.price, w)}


def daily_return(w: WindowSpec, i: Inputs) -> dict[str, Column]:
    return {"Daily_Return": ratio(i.price, shift(i.price, 1, w)) - 1}


def mean_column(name: str, source: str, n: int) -> Indicator:
    return Indicator(n - 1, lambda w, i: {name: rolling_mean(getattr(i, source), n, w)})


def mean_of_parts(name: str, n: int, size: int) -> Indicator:
    """The mean of doubles by sums of ``size`` rows, ``n / size`` of which make the window."""
    return Indicator(
        n - 1,
        lambda w, i: {f"_part_{n}": F.sum(i.price).over(w.rowsBetween(-(size - 1), 0)), f"_known_{n}": known(i.price, n, w)},
        lambda w, i: {name: F.when(F.col(f"_known_{n}") == n, reduce(add, with_earlier(f"_part_{n}", n, size, w)) / n)},
    )


def middle_and_spread(w: WindowSpec, i: Inputs) -> dict[str, Column]:
    return {"_middle": rolling_mean(i.price, MIDDLE, w), "_spread": rolling_std(i.price, MIDDLE, w)}


def band(name: str, sign: int) -> Indicator:
    return Indicator(
        MIDDLE - 1,
        middle_and_spread,
        last=lambda i: {name: F.col("_middle") + sign * BAND_WIDTH * F.col("_spread")},
    )


def gains_and_losses(w: WindowSpec, i: Inputs) -> dict[str, Column]:
    # An unknown change (the first row of a series) counts as no change here.
    frame = w.rowsBetween(-(SHORT - 1), 0)
    zero = F.lit(0.0)
    return {
        "_gain": F.when(F.count(F.lit(1)).over(so_far(w)) >= SHORT, F.sum(F.greatest(F.col("_change"), zero)).over(frame) / SHORT),
        "_loss": F.sum(F.greatest(-F.col("_change"), zero)).over(frame) / SHORT,
    }


def strength_index(i: Inputs) -> dict[str, Column]:
    return {"RSI": ratio(100 * F.col("_gain"), F.col("_gain") + F.col("_loss"))}


def range_of_prices(w: WindowSpec, i: Inputs) -> dict[str, Column]:
    part = w.rowsBetween(-(PART - 1), 0)
    return {"_low_part": F.min(i.price).over(part), "_high_part": F.max(i.price).over(part), "_known_prices": known(i.price, SHORT, w)}


def range_of_parts(w: WindowSpec, i: Inputs) -> dict[str, Column]:
    full = F.col("_known_prices") == SHORT
    return {
        "_lowest": F.when(full, F.least(*with_earlier("_low_part", SHORT, PART, w))),
        "_highest": F.when(full, F.greatest(*with_earlier("_high_part", SHORT, PART, w))),
    }


def stochastic(i: Inputs) -> dict[str, Column]:
    above = F.col(i.price) - F.col("_lowest")
    return {"Stochastic_K": 100 * ratio(above, F.col("_highest") - F.col("_lowest"))}


def signal_line(i: Inputs) -> dict[str, Column]:
    quick = F.col("_mean_signal")
    fast = chained(MACD_SIGNAL, MACD_FAST, quick, F.col("_mean_fast"))
    slow = chained(MACD_SIGNAL, MACD_SLOW, quick, F.col("_mean_slow"))
    return {"Signal_Line": fast - slow}


MACD_MEANS = {"_mean_fast": MACD_FAST, "_mean_slow": MACD_SLOW}

INDICATORS: dict[str, Indicator] = {
    "SMA_20": mean_column("SMA_20", "price", MIDDLE),
    "SMA_50": mean_column("SMA_50", "price", LONG),
    "EMA_20": Indicator(reach(MIDDLE), means={"EMA_20": MIDDLE}),
    "BB_middle": band("BB_middle", 0),
    "BB_upper": band("BB_upper", 1),
    "BB_lower": band("BB_lower", -1),
    "RSI": Indicator(SHORT, change, gains_and_losses, strength_index),
    "MACD": Indicator(
        reach(MACD_SLOW), means=MACD_MEANS, last=lambda i: {"MACD": F.col("_mean_fast") - F.col("_mean_slow")}
    ),
    "Signal_Line": Indicator(reach(MACD_SLOW), means={**MACD_MEANS, "_mean_signal": MACD_SIGNAL}, last=signal_line),
    "ATR": Indicator(SHORT, change, lambda w, i: {"ATR": rolling_mean("_change", SHORT, w)}),
    "OBV": Indicator(1, change, running=True),
    "Stochastic_K": Indicator(SHORT - 1, range_of_prices, range_of_parts, stochastic),
    "Daily_Return": Indicator(1, daily_return),
    "Volatility": Indicator(
        MIDDLE,
        daily_return,
        lambda w, i: {"Volatility": rolling_std("Daily_Return", MIDDLE, w) * math.sqrt(i.periods_per_year)},
    ),
    "Volume_MA": mean_column("Volume_MA", "volume", MIDDLE),
    "Volume_Ratio": Indicator(
        MIDDLE - 1,
        lambda w, i: {"Volume_MA": rolling_mean(i.volume, MIDDLE, w)},
        last=lambda i: {"Volume_Ratio": ratio(i.volume, "Volume_MA")},
    ),
    "Sentiment_7D_Rolling": mean_column("Sentiment_7D_Rolling", "sentiment", SENTIMENT_SHORT),
    "Sentiment_14D_Rolling": mean_column("Sentiment_14D_Rolling", "sentiment", SENTIMENT_LONG),
    "Sentiment_7D_Lagged": Indicator(
        2 * SENTIMENT_SHORT - 1,
        lambda w, i: {"Sentiment_7D_Rolling": rolling_mean(i.sentiment, SENTIMENT_SHORT, w)},
        lambda w, i: {"Sentiment_7D_Lagged": shift("Sentiment_7D_Rolling", SENTIMENT_SHORT, w)},
    ),
    "Sentiment_14D_Lagged": Indicator(
        2 * SENTIMENT_LONG - 1,
        lambda w, i: {"Sentiment_14D_Rolling": rolling_mean(i.sentiment, SENTIMENT_LONG, w)},
        lambda w, i: {"Sentiment_14D_Lagged": shift("Sentiment_14D_Rolling", SENTIMENT_LONG, w)},
    ),
}

# The same for prices that are doubles, with less to sum up per row.
OF_DOUBLES = {
    "SMA_20": mean_of_parts("SMA_20", MIDDLE, PART),
    "SMA_50": mean_of_parts("SMA_50", LONG, 2 * PART),
    "ATR": Indicator(SHORT, change, lambda w, i: {"ATR": when_full(F.sum, "_change", SHORT, w) / SHORT}),
}

PRICE_INDICATORS = [name for name in INDICATORS if not name.startswith("Sentiment")]
MODEL_FEATURES = ["SMA_20", "SMA_50", "EMA_20", "RSI", "MACD", "ATR", "Stochastic_K", "OBV"]


def exponential_over_gaps(df: DataFrame, inputs: Inputs = Inputs(), series: Series = SERIES) -> DataFrame:
    """Add EMA_20, MACD and Signal_Line of prices with NULLs anywhere, as the recursion gives them.

    A day without a price repeats its means, so the signal line has no gaps once there is a price. This takes two shuffles;
    ``add_indicators`` takes one, for prices without gaps.
    """
    first = {"EMA_20": (inputs.price, MIDDLE), "_mean_fast": (inputs.price, MACD_FAST), "_mean_slow": (inputs.price, MACD_SLOW)}
    rows = ewm_means_over_gaps(df, first, series).withColumn("MACD", F.col("_mean_fast") - F.col("_mean_slow"))
    rows = ewm_means_over_gaps(rows.drop("_mean_fast", "_mean_slow"), {"Signal_Line": ("MACD", MACD_SIGNAL)}, series)
    return rows.select(*[c for c in df.columns if c not in ("EMA_20", "MACD", "Signal_Line")], "EMA_20", "MACD", "Signal_Line")


def look_back(names: list[str]) -> int:
    """How many earlier rows the named indicators look back at."""
    return max(INDICATORS[name].look_back for name in names)


def add_indicators(
    df: DataFrame, names: list[str] | None = None, inputs: Inputs = Inputs(), series: Series = SERIES, halo: int | None = None
) -> DataFrame:
    """Add the named indicators (all that the columns allow by default).

    Rows without key or date belong to no series and are left out, here as in all windowed operators. ``halo`` states that
    ``df`` is laid out already, with so many earlier rows (``densify`` with the same ``halo``): nothing is shuffled then.
    """
    if names is None:
        names = list(INDICATORS) if inputs.sentiment in df.columns else PRICE_INDICATORS
    unknown = [name for name in names if name not in INDICATORS]
    if unknown:
        raise ValueError(f"unknown indicators: {unknown}")
    kinds = OF_DOUBLES if df.schema[inputs.price].dataType == DoubleType() else {}
    chosen = [kinds.get(name, INDICATORS[name]) for name in names]
    if any(name.startswith("Sentiment") for name in names) and inputs.sentiment not in df.columns:
        raise ValueError(f"column {inputs.sentiment} is missing")

    w = block_window(series)
    means = {out: (inputs.price, span) for one in chosen for out, span in one.means.items()}
    needed = max(one.look_back for one in chosen)
    if halo is not None and halo < needed:
        raise ValueError(f"rows are laid out with {halo} earlier rows, {needed} are needed")
    running = any(one.running for one in chosen)
    rows = lay_out(df, needed, series) if halo is None else df
    if halo is None and (means or running):
        rows = place(rows, series)
    laid = rows
    if means:
        rows = rows.withColumns(local_sums(means, series))
    signed = F.coalesce((F.signum("_change") * F.col(inputs.volume)).cast("double"), F.lit(0.0))
    for stage in (
        {**{k: v for one in chosen for k, v in one.first(w, inputs).items()}, **carried_over(means, w)},
        {
            **{k: v for one in chosen for k, v in one.second(w, inputs).items()},
            **combined(means),
            **({"_since": F.sum(F.when(~F.col(HALO), signed)).over(so_far(w))} if running else {}),
        },
        {k: v for one in chosen for k, v in one.last(inputs).items()},
    ):
        if stage:
            rows = rows.withColumns(stage)
    if running:
        # Last, when nothing needs the order of rows any more. A day that repeats the day before moves no volume.
        moves = laid.where(~F.col(REPEATS)) if REPEATS in laid.columns else laid
        moves = moves.withColumns(change(w, inputs)).withColumn("_signed", signed)
        rows = with_carry(
            rows.where(~F.col(HALO)),
            moves,
            {"_total": F.sum("_signed")},
            lambda earlier, _: {"_carry": F.sum("_total").over(earlier)},
            series,
        ).withColumn("OBV", F.coalesce(F.col("_carry"), F.lit(0.0)) + F.col("_since"))
    kept = [c for c in df.columns if halo is None or c not in (POS, BLOCK, HALO, REPEATS)]
    return trim(rows).select(*kept, *names)


def rsi_flags(df: DataFrame, high: float = OVERBOUGHT, low: float = OVERSOLD) -> DataFrame:
    """Mark rows above or below the two RSI levels."""
    flag = F.when(F.col("RSI") > high, "overbought").when(F.col("RSI") < low, "oversold")
    return df.withColumn("RSI_flag", F.when(F.col("RSI").isNotNull(), F.coalesce(flag, F.lit("neutral"))))
