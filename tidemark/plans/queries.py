"""One named query per operator, over the given test tables.

Results are shaped for comparison: days as text, prices to four decimals (``level``), and
differences and ratios rounded (``PLACES``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import clean_text
from tidemark.functions.dates import parse_date
from tidemark.functions.numbers import rounded
from tidemark.operators import aggregates, calendar, cumulative, ewm, features, filling, forecast, rolling, statistics
from tidemark.operators.blocks import over_blocks
from tidemark.operators.indicators import add_indicators, exponential_over_gaps, look_back, rsi_flags
from tidemark.operators.sentiment import lexicon_score
from tidemark.plans import market, panels
from tidemark.series import PANEL, Series
from tidemark.session import new_table_path, written
from tidemark.sources import missing_keys, numbered_panel, read_panel, read_panel_dates, read_prices, read_tweets, standardize, union_prices, write_panel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PANEL_COLUMNS = "Date date, Ticker string, Close double, Volume double"

# The price columns, and decimals of the others.
LEVELS = [
    "Close", "SMA_20", "SMA_50", "EMA_20", "BB_middle", "BB_upper", "BB_lower", "Close_std_20", "Close_min_14",
    "Close_max_14", "Close_lag_7", "median", "Benchmark_Close", "forecast", "actual", "first_close", "last_close", "y",
    "ATR", "Close_diff",
]
PLACES = {
    "RSI": 4, "MACD": 4, "Signal_Line": 4, "Stochastic_K": 4, "Volatility": 4, "mean_Volatility": 6,
    "Daily_Return": 6, "Volume_Ratio": 6, "sentiment": 6, "sentiments": 6, "Close_pct": 6, "r": 6, "x": 6,
    "density": 5, "count_scaled": 4, "left": 6, "right": 6, "Stock_Return": 6, "Benchmark_Return": 6, "error": 2,
    "Stock_Cumulative_Return": 4, "Benchmark_Cumulative_Return": 4, "Cumulative_Return": 4, 
    "Close_scaled": 6, "Volume_scaled": 6, "Sentiment_7D_Rolling": 6, "Sentiment_14D_Rolling": 6,
    "Sentiment_7D_Lagged": 6, "Sentiment_14D_Lagged": 6,
}


def level(c: str) -> Column:
    """Four decimals, halves upwards. Means of prices often end in a half: by way of six decimals the noise of sums goes first."""
    return F.round(F.col(c).cast("decimal(28,6)"), 4).cast("double")


def comparable(df: DataFrame) -> DataFrame:
    shaped = []
    for name, kind in df.dtypes:
        if kind == "date":
            shaped.append(F.col(name).cast("string").alias(name))
        elif name in LEVELS:
            shaped.append((rounded(name, 4, level(name)) if kind == "double" else level(name)).alias(name))
        elif name in PLACES:
            exactly = F.round(name, PLACES[name])
            shaped.append((rounded(name, PLACES[name], exactly) if kind == "double" else exactly).alias(name))
        elif kind == "int":
            shaped.append(F.col(name).cast("bigint").alias(name))
        else:
            shaped.append(F.col(name))
    return df.select(*shaped)


def named(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return comparable(build(spark, folder))

        QUERIES[name] = run
        return build

    return register


def query(build: Query) -> Query:
    return named(build.__name__)(build)


def indicator_query(name: str, *columns: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = add_indicators(market.panel(spark, folder), list(columns), series=PANEL)
        return comparable(rows.select("Date", "Ticker", *columns))

    QUERIES[name] = run


def panel_with_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    scored = lexicon_score(market.parsed_tweets(spark, folder), id="doc_id", keep=("Date", "Ticker"))
    return aggregates.attach_sentiment(market.panel(spark, folder), scored)


def returns(spark: SparkSession, folder: str) -> DataFrame:
    return add_indicators(market.panel(spark, folder), ["Daily_Return"], series=PANEL)


def scratch_folder(spark: SparkSession) -> str:
    return new_table_path(spark, "panel")


# -- building the panel ---------------------------------------------------------------------


@query
def daily_mean(spark, folder):
    return aggregates.daily_mean(market.ticks(spark, folder))


@named("calendar")
def calendar_days(spark, folder):
    return calendar.calendar(market.ticks(spark, folder))


@query
def densify(spark, folder):
    days = calendar.first_and_last_day(market.ticks(spark, folder))
    return calendar.densify(market.prices(spark, folder), fill=False, span=days)


@query
def densify_listed_keys(spark, folder):
    keys = ["1-URGENT", "5-LOW", "6-UNKNOWN"]
    dense = calendar.densify(market.prices(spark, folder), keys=keys)
    return filling.fill_residual(dense)


@query
def ffill(spark, folder):
    days = calendar.first_and_last_day(market.ticks(spark, folder))
    gaps = calendar.densify(market.prices(spark, folder), fill=False, span=days)
    return cumulative.ffill(gaps, ["Close", "Volume"], PANEL)


@query
def median_fill_global(spark, folder):
    return filling.fill_residual(market.dense(spark, folder))


@query
def median_fill_key(spark, folder):
    return filling.fill_residual(market.dense(spark, folder), scope="key")


@query
def median_price(spark, folder):
    return statistics.lower_median(market.ticks(spark, folder), "Close")


@query
def fill_neutral(spark, folder):
    scored = lexicon_score(market.parsed_tweets(spark, folder), id="doc_id", keep=("Date", "Ticker"))
    days = market.prices(spark, folder).join(aggregates.daily_sentiment(scored), ["Date", "Ticker"], "left")
    return filling.fill_const(days.select("Date", "Ticker", "sentiment"), {"sentiment": 0.0})


@query
def panel(spark, folder):
    return market.panel(spark, folder)


@query
def key_filter(spark, folder):
    kept = filling.filter_keys(market.ticks(spark, folder), ["2-HIGH", "5-LOW", "no such key"])
    return kept.groupBy("Ticker").agg(F.count(F.lit(1)).alias("n"), F.max("Close").alias("highest"))


@query
def key_filter_table(spark, folder):
    """The same filter with a table of keys: suppliers of positive balance."""
    keys = market.table(spark, folder, "supplier").where("s_acctbal > 0")
    named = keys.select(F.col("s_suppkey").cast("string").alias("Ticker"))
    kept = filling.filter_keys(market.supplier_prices(spark, folder), named)
    return kept.groupBy("Ticker").agg(F.count(F.lit(1)).alias("n"))


@query
def rename_standard(spark, folder):
    lower = market.prices(spark, folder).withColumnsRenamed({"Close": "close", "Volume": "volume"})
    return standardize(lower)


@query
def union_sources(spark, folder):
    events = market.table(spark, folder, "events").select(
        F.to_date("ts").alias("Date"), F.col("event_type").alias("Ticker"), F.col("value").alias("Close"), F.lit(1).alias("Volume")
    )
    both = union_prices([market.ticks(spark, folder), events])
    return both.groupBy("Ticker").agg(
        F.sum("Volume").alias("Volume"), F.min("Date").alias("first_day"), F.max("Date").alias("last_day"), F.max("Close").alias("highest")
    )


@query
def write_read_roundtrip(spark, folder):
    path = scratch_folder(spark)
    write_panel(market.panel(spark, folder), path)
    return read_panel(spark, path, schema=PANEL_COLUMNS)


@query
def read_some_keys(spark, folder):
    """Of a written panel, only the folders of two keys are read."""
    path = scratch_folder(spark)
    write_panel(market.panel(spark, folder), path)
    return read_panel(spark, path, keys=["2-HIGH", "5-LOW"], schema=PANEL_COLUMNS)


@query
def csv_roundtrip(spark, folder):
    """The panel as text files and back, with the place of each row in its file: rows must be in date order."""
    path = scratch_folder(spark)
    write_panel(market.panel(spark, folder), path, "csv")
    back = read_panel(spark, path, "csv", schema=PANEL_COLUMNS)
    place = F.struct("_metadata.file_path", F.monotonically_increasing_id())
    rows = back.select("*", F.col("_metadata.file_path").alias("_file"), place.alias("_place"))
    in_file = Window.partitionBy("_file").orderBy("_place")
    return rows.select("Date", "Ticker", "Close", "Volume", F.row_number().over(in_file).alias("nth"))


@query
def read_some_dates(spark, folder):
    """Of a written panel, only the files that hold days of a quarter are opened."""
    path = scratch_folder(spark)
    write_panel(market.panel(spark, folder), path, series=Series(daily=True, block_rows=64))
    return read_panel_dates(spark, path, "1996-01-20", "1996-04-19", schema=PANEL_COLUMNS)


@query
def panel_in_file_order(spark, folder):
    """A written panel with the number of each row in its series, as told by the order of files and of rows in them."""
    path = scratch_folder(spark)
    write_panel(market.panel(spark, folder), path, series=Series(daily=True, block_rows=64))
    return numbered_panel(spark, path, PANEL_COLUMNS)


def written_price_files(spark: SparkSession, folder: str) -> str:
    """A folder with a price file per key, named by it, as price files come: all columns, days with orders only."""
    root = scratch_folder(spark)
    rows = market.prices(spark, folder).select("Ticker", "Date", *[F.col("Close").alias(c) for c in ("Open", "High", "Low", "Close", "Adj Close")], F.col("Volume").cast("bigint").alias("Volume"))
    parts = rows.repartition("Ticker").sortWithinPartitions("Ticker", "Date")
    parts.write.option("header", True).partitionBy("Ticker").csv(f"{root}/parts")
    files = spark._jvm.org.apache.hadoop.fs
    for row in spark.read.format("binaryFile").load(f"{root}/parts").select("path", "Ticker").collect():
        source, target = files.Path(row.path), files.Path(f"{root}/{row.Ticker}.csv")
        source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target)
    return root


@query
def price_files(spark, folder):
    """Price files of three keys, one of which has none, read out of a folder of all."""
    return read_prices(spark, written_price_files(spark, folder), ["1-URGENT", "5-LOW", "6-UNKNOWN"])


@query
def price_files_missing(spark, folder):
    """Customers' order priorities and two keys more: those without a price file."""
    root = written_price_files(spark, folder)
    keys = market.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("key"))
    more = spark.createDataFrame([("6-UNKNOWN",), ("no [such] key",)], "key string")
    return missing_keys(spark, root, keys.union(more))


@query
def tweet_files(spark, folder):
    """Texts with blanks, quotes and line breaks written as CSV and read back: days, keys and digests."""
    path = scratch_folder(spark)
    market.tweets(spark, folder).drop("doc_id").write.option("header", True).option("escape", '"').csv(path)
    rows = read_tweets(spark, path, keys=["1-URGENT", "4-NOT SPECIFIED"], multiline=True)
    return rows.groupBy("Date", "Ticker").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list(F.md5("tweet"))), ",")).alias("digest"))


@query
def panel_of_gappy_prices(spark, folder):
    """Prices of which every third is unknown, through both medians: of observed rows, and of days before a key's first."""
    return panels.dense_prices(market.gappy_trades(spark, folder))


@query
def tweet_driven_gappy_prices(spark, folder):
    return panels.tweet_driven(market.gappy_trades(spark, folder), market.parsed_tweets(spark, folder), tweet_id="doc_id")


@query
def iso_date(spark, folder):
    """Order days as text, year first, of which every seventh isn't a date."""
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    days = market.table(spark, folder, "orders").select(text.alias("day")).select(parse_date("day").alias("Date"))
    return days.groupBy("Date").agg(F.count(F.lit(1)).alias("n"))


@query
def rename_sentiment(spark, folder):
    lower = panel_with_sentiment(spark, folder).withColumnsRenamed({"Close": "close", "Volume": "volume"})
    return standardize(lower)


# -- window primitives ------------------------------------------------------------------------


@query
def rolling_minmax(spark, folder):
    return over_blocks(
        market.panel(spark, folder),
        13,
        lambda w: {"Close_min_14": rolling.rolling_min("Close", 14, w), "Close_max_14": rolling.rolling_max("Close", 14, w)},
        series=PANEL,
    ).select("Date", "Ticker", "Close_min_14", "Close_max_14")


@query
def rolling_std(spark, folder):
    rows = rolling.add_rolling(market.panel(spark, folder), "Close", 20, "std", series=PANEL)
    return rows.select("Date", "Ticker", "Close_std_20")


@query
def rolling_sparse(spark, folder):
    """Row windows over the observed days only: positions by rank, not by calendar."""
    rows = rolling.add_rolling(market.prices(spark, folder), "Close", 20, "mean", "SMA_20")
    return rows.select("Date", "Ticker", "SMA_20")


@query
def shift_diff(spark, folder):
    return over_blocks(
        market.panel(spark, folder),
        7,
        lambda w: {"Close_lag_7": rolling.shift("Close", 7, w), "Close_diff": rolling.diff("Close", w)},
        series=PANEL,
    ).select("Date", "Ticker", "Close_lag_7", "Close_diff")


@query
def pct_change(spark, folder):
    rows = over_blocks(
        market.panel(spark, folder), 1, lambda w: {"Close_pct": rolling.pct_change("Close", w)}, series=PANEL
    )
    return rows.select("Date", "Ticker", "Close_pct")


@query
def cumsum(spark, folder):
    rows = cumulative.cumsum(market.panel(spark, folder), "Volume", "Volume_total", PANEL)
    return rows.select("Date", "Ticker", "Volume_total")


@query
def cumreturn(spark, folder):
    rows = cumulative.cumreturn(returns(spark, folder), {"Cumulative_Return": "Daily_Return"}, PANEL)
    return rows.select("Date", "Ticker", "Cumulative_Return")


@query
def ema_sparse(spark, folder):
    """Exponential mean over observed days, whatever the gaps between them."""
    return ewm.ewm_mean(market.prices(spark, folder), "Close", 20, "EMA_20").select("Date", "Ticker", "EMA_20")


@query
def ema_with_gaps(spark, folder):
    """Days without orders stay NULL: the mean fades over them."""
    rows = market.ticks(spark, folder)
    gaps = calendar.densify(market.daily(rows), ("Close",), fill=False, span=calendar.first_and_last_day(rows))
    rows = ewm.ewm_mean_with_gaps(gaps, "Close", 20, "EMA_20", PANEL)
    # Fading goes by logarithms, which leaves some 2e-12 of a value as noise: one decimal is compared.
    return rows.select("Date", "Ticker", F.round(F.col("EMA_20").cast("decimal(28,6)"), 1).cast("double").alias("EMA_20"))


@query
def indicators_over_gaps(spark, folder):
    """Exponential indicators where days without orders stay NULL."""
    rows = market.ticks(spark, folder)
    gaps = calendar.densify(market.daily(rows), ("Close",), fill=False, span=calendar.first_and_last_day(rows))
    return exponential_over_gaps(gaps, series=PANEL).drop("Close")


@query
def last_n(spark, folder):
    return rolling.last_n(market.panel(spark, folder), 7)


@query
def horizon(spark, folder):
    return calendar.horizon(market.panel(spark, folder), 7)


# -- indicators -------------------------------------------------------------------------------

indicator_query("sma", "SMA_20", "SMA_50")
indicator_query("ema_20", "EMA_20")
indicator_query("bollinger", "BB_middle", "BB_upper", "BB_lower")
indicator_query("rsi", "RSI")
indicator_query("macd", "MACD")
indicator_query("signal_line", "MACD", "Signal_Line")
indicator_query("atr_close", "ATR")
indicator_query("obv", "OBV")
indicator_query("stochastic_k", "Stochastic_K")
indicator_query("daily_return", "Daily_Return")
indicator_query("volatility", "Volatility")
indicator_query("volume_ratio", "Volume_MA", "Volume_Ratio")


@named("rsi_flags")
def rsi_levels(spark, folder):
    rows = add_indicators(market.panel(spark, folder), ["RSI"], series=PANEL)
    return rsi_flags(rows).groupBy("Ticker", "RSI_flag").agg(F.count(F.lit(1)).alias("n"))


@query
def sentiment_rolling(spark, folder):
    names = ["Sentiment_7D_Rolling", "Sentiment_14D_Rolling"]
    rows = add_indicators(panel_with_sentiment(spark, folder), names, series=PANEL)
    return rows.select("Date", "Ticker", *names)


@query
def sentiment_lagged(spark, folder):
    names = ["Sentiment_7D_Lagged", "Sentiment_14D_Lagged"]
    rows = add_indicators(panel_with_sentiment(spark, folder), names, series=PANEL)
    return rows.select("Date", "Ticker", *names)


@query
def indicators_all(spark, folder):
    return add_indicators(panel_with_sentiment(spark, folder), series=PANEL)


@query
def supplier_indicators(spark, folder):
    """Many keys: every supplier's daily series, laid dense, with the windowed indicators."""
    span = calendar.first_and_last_day(market.shipped(spark, folder))
    names = ["SMA_20", "RSI", "ATR", "OBV", "Stochastic_K"]
    halo = look_back(names)
    dense = calendar.densify(market.supplier_days(spark, folder), span=span, series=PANEL, halo=halo)
    rows = add_indicators(dense, names, series=PANEL, halo=halo).drop("Close", "Volume")
    return rows.withColumn("Ticker", F.col("Ticker").cast("string"))


@query
def event_indicators(spark, folder):
    """A short history: the event days are fewer than the long window needs."""
    events = market.table(spark, folder, "events").select(
        F.to_date("ts").alias("Date"), F.col("event_type").alias("Ticker"), F.col("value").alias("Close"), F.lit(1.0).alias("Volume")
    )
    dense = calendar.densify(aggregates.daily_mean(events), span=calendar.first_and_last_day(events))
    return add_indicators(dense, ["SMA_20", "SMA_50", "RSI", "ATR"], series=PANEL).drop("Close", "Volume")


@query
def benchmark_compare(spark, folder):
    joined = aggregates.attach_benchmark(market.panel(spark, folder), market.benchmark(spark, folder))
    return cumulative.benchmark_compare(joined, series=PANEL).drop("Close", "Volume", "Benchmark_Close")


# -- text -------------------------------------------------------------------------------------


@named("clean_text")
def clean_texts(spark, folder):
    cleaned = market.tweets(spark, folder).select("doc_id", clean_text("tweet").alias("_text"))
    return cleaned.select("doc_id", F.length("_text").alias("length"), F.md5("_text").alias("digest"))


@query
def dayfirst_date(spark, folder):
    return market.parsed_tweets(spark, folder).select("doc_id", "Date", "Ticker")


@named("lexicon_score")
def lexicon_scores(spark, folder):
    return lexicon_score(market.tweets(spark, folder), id="doc_id")


@query
def lexicon_negation(spark, folder):
    return lexicon_score(market.tweets(spark, folder), id="doc_id", negation=True)


@query
def daily_sentiment(spark, folder):
    scored = lexicon_score(market.parsed_tweets(spark, folder), id="doc_id", keep=("Date", "Ticker"))
    return aggregates.daily_sentiment(scored)


# -- whole panels -----------------------------------------------------------------------------


@query
def panel_driven(spark, folder):
    return panels.panel_driven(
        market.trades(spark, folder), market.parsed_tweets(spark, folder), tweet_id="doc_id"
    )


@query
def tweet_driven(spark, folder):
    return panels.tweet_driven(
        market.trades(spark, folder), market.parsed_tweets(spark, folder), tweet_id="doc_id"
    )


# -- statistics -------------------------------------------------------------------------------

CORRELATED = ["Close", "Volume", "SMA_20", "SMA_50", "sentiment"]


@query
def correlation_matrix(spark, folder):
    rows = add_indicators(panel_with_sentiment(spark, folder), ["SMA_20", "SMA_50"], series=PANEL)
    return statistics.correlation_matrix(rows, CORRELATED)


@query
def correlation_by_key(spark, folder):
    rows = add_indicators(panel_with_sentiment(spark, folder), ["SMA_20", "SMA_50"], series=PANEL)
    return statistics.correlation_matrix(rows, CORRELATED, by="Ticker")


@query
def mean_volatility(spark, folder):
    rows = add_indicators(market.panel(spark, folder), ["Volatility"], series=PANEL)
    return statistics.mean_of(rows, "Volatility", by="Ticker")


@query
def return_histogram(spark, folder):
    # Automatic bins read their input several times: a written copy, not the whole panel job again.
    return statistics.histogram(written(returns(spark, folder).select("Daily_Return"), "returns"), "Daily_Return")


@query
def return_histogram_auto_by_key(spark, folder):
    rows = written(returns(spark, folder).select("Ticker", "Daily_Return"), "returns")
    return statistics.histogram(rows, "Daily_Return", by="Ticker")


@query
def return_histogram_by_key(spark, folder):
    return statistics.histogram(returns(spark, folder), "Daily_Return", bins=40, by="Ticker")


@query
def return_kde(spark, folder):
    return statistics.kde(returns(spark, folder), "Daily_Return")


@query
def return_kde_by_key(spark, folder):
    """Density per key as drawn over its histogram: within the data, scaled to counts of 40 bins."""
    return statistics.kde(returns(spark, folder), "Daily_Return", by="Ticker", cut=0.0, bins=40)


# -- features and forecasts -------------------------------------------------------------------


@query
def minmax_scale(spark, folder):
    rows = market.panel(spark, folder)
    scaled = features.minmax_scale(rows, ["Close", "Volume"])
    return scaled.withColumnsRenamed({"Close": "Close_scaled", "Volume": "Volume_scaled"})


@query
def minmax_invert(spark, folder):
    rows = market.panel(spark, folder)
    limits = features.minmax_stats(rows, ["Close"])
    scaled = features.minmax_scale(rows, ["Close"], stats=limits)
    return features.minmax_invert(scaled, "Close", limits).select("Date", "Ticker", "Close")


@query
def lookback(spark, folder):
    rows = features.lookback(market.panel(spark, folder), ["Close", "Volume"], "Close", 60, PANEL)
    volume = F.aggregate("X", F.lit(0.0), lambda total, row: total + F.get(row, F.lit(1)))
    return rows.select(
        "Date",
        "Ticker",
        F.size("X").alias("length"),
        F.get(F.get("X", F.lit(0)), F.lit(0)).alias("first_close"),
        F.get(F.element_at("X", -1), F.lit(0)).alias("last_close"),
        volume.alias("volume_sum"),
        "y",
    )


@query
def feature_matrix(spark, folder):
    rows = add_indicators(market.panel(spark, folder), features.MODEL_FEATURES, series=PANEL)
    return features.feature_matrix(rows)


@query
def ar_forecast(spark, folder):
    return forecast.ar_forecast(market.panel(spark, folder), series=PANEL)


@query
def ar_exog_forecast(spark, folder):
    rows = add_indicators(market.panel(spark, folder), features.MODEL_FEATURES, series=PANEL)
    return forecast.ar_exog_forecast(rows, features.MODEL_FEATURES, series=PANEL)


@query
def compare_forecast(spark, folder):
    older, newest = forecast.hold_out(market.panel(spark, folder))
    return forecast.compare_forecast(newest, forecast.ar_forecast(older, series=PANEL))


def lookback_rows(spark, folder) -> tuple[DataFrame, DataFrame, list[str]]:
    """Price and model inputs scaled by key, the limits used, and the names of the columns."""
    columns = ["Close", *features.MODEL_FEATURES]
    rows = add_indicators(market.panel(spark, folder), features.MODEL_FEATURES, series=PANEL).na.fill(0.0)
    # The limits, the fit and the last rows each pass over the inputs: they read a written copy.
    rows = written(rows.select("Date", "Ticker", *columns), "features")
    limits = features.minmax_stats(rows, columns)
    return features.minmax_scale(rows, columns, stats=limits), limits, columns


@query
def lookback_linear_forecast(spark, folder):
    scaled, limits, columns = lookback_rows(spark, folder)
    model = forecast.fit_lookback(scaled, columns, "Close", 60, series=PANEL)
    ahead = forecast.rollout(model, forecast.last_sequence(scaled, columns, 60))
    return features.minmax_invert(ahead, "Close", limits, out="forecast", source="forecast")


@query
def lookback_fit_residuals(spark, folder):
    """Mean product of the fit's residuals with each of its 540 inputs, to five decimals: 0 for a least-squares fit."""
    scaled, _, columns = lookback_rows(spark, folder)
    model = forecast.fit_lookback(scaled, columns, "Close", 60, series=PANEL)
    means = forecast.lookback_residuals(model, features.lookback(scaled, columns, "Close", 60, PANEL))
    return means.select("lag", "column", (F.round("mean", 5) + 0.0).alias("mean"))


@query
def lookback_short_forecast(spark, folder):
    """The same model over price and volume of the last three days, which SQL can solve."""
    columns = ["Close", "Volume"]
    rows = market.panel(spark, folder)
    limits = features.minmax_stats(rows, columns)
    scaled = written(features.minmax_scale(rows, columns, stats=limits), "scaled")
    model = forecast.fit_lookback(scaled, columns, "Close", 3, 0.0, PANEL)
    ahead = forecast.rollout(model, forecast.last_sequence(scaled, columns, 3))
    return features.minmax_invert(ahead, "Close", limits, out="forecast", source="forecast")
