"""All indicators, correlations and distributions of invented files, against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.calendar import densify
from tidemark.operators.cumulative import cumreturn
from tidemark.operators.indicators import INDICATORS, add_indicators
from tidemark.operators.statistics import correlation_matrix, histogram, histogram_bounds, kde
from tidemark.series import PANEL
from tidemark.sources import read_panel, read_prices

# 0-based row of the first defined value.
FIRST_ROW = {
    "Sentiment_7D_Rolling": 6, "Sentiment_14D_Rolling": 13, "Sentiment_7D_Lagged": 13, "Sentiment_14D_Lagged": 27,
    "SMA_20": 19, "SMA_50": 49, "EMA_20": 0, "MACD": 0, "Signal_Line": 0, "OBV": 0, "RSI": 13, "BB_upper": 19,
    "ATR": 14, "Stochastic_K": 13, "Daily_Return": 1, "Volatility": 20, "Volume_MA": 19, "Cumulative": 1,
}


def expected(rows: pd.DataFrame) -> pd.DataFrame:
    close, volume, said = rows.Close, rows.Volume, rows.sentiment
    change, ema = close.diff(), lambda span: close.ewm(span=span, adjust=False).mean()
    gain, loss = (change.clip(lower=0).fillna(0).rolling(14).mean(), (-change).clip(lower=0).fillna(0).rolling(14).mean())
    middle, spread = close.rolling(20).mean(), close.rolling(20).std()
    low, high = close.rolling(14).min(), close.rolling(14).max()
    macd, returns = ema(12) - ema(26), close.pct_change()
    out = {
        "SMA_20": middle, "SMA_50": close.rolling(50).mean(), "EMA_20": ema(20), "BB_middle": middle,
        "BB_upper": middle + 2 * spread, "BB_lower": middle - 2 * spread, "RSI": 100 * gain / (gain + loss),
        "MACD": macd, "Signal_Line": macd.ewm(span=9, adjust=False).mean(), "ATR": change.rolling(14).mean(),
        "OBV": (np.sign(change).fillna(0) * volume).cumsum(), "Stochastic_K": 100 * (close - low) / (high - low),
        "Daily_Return": returns, "Volatility": returns.rolling(20).std() * np.sqrt(252),
        "Volume_MA": volume.rolling(20).mean(), "Volume_Ratio": volume / volume.rolling(20).mean(),
        "Sentiment_7D_Rolling": said.rolling(7).mean(), "Sentiment_14D_Rolling": said.rolling(14).mean(),
        "Sentiment_7D_Lagged": said.rolling(7).mean().shift(7), "Sentiment_14D_Lagged": said.rolling(14).mean().shift(14),
        "Cumulative": (1 + returns).cumprod() - 1,
    }
    return pd.DataFrame(out).reset_index(drop=True)


@pytest.fixture(scope="module")
def sample(spark, panel_folder):
    panel = read_panel(spark, panel_folder, "csv")
    rows = cumreturn(add_indicators(panel, series=PANEL), {"Cumulative": "Daily_Return"}, PANEL)
    return rows.toPandas().sort_values(["Ticker", "Date"]).reset_index(drop=True)


def test_every_indicator(sample, panel_frame):
    assert set(INDICATORS) <= set(expected(panel_frame).columns)
    for key, rows in panel_frame.groupby("Ticker"):
        got = sample[sample.Ticker == key].reset_index(drop=True)
        assert [str(d) for d in got.Date] == list(rows.Date.dt.strftime("%Y-%m-%d"))
        for name, want in expected(rows.reset_index(drop=True)).items():
            np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-7, atol=1e-9 * max(1, want.abs().max()), err_msg=f"{key} {name}")


def test_first_defined_row(sample):
    for _, rows in sample.groupby("Ticker"):
        rows = rows.reset_index(drop=True)
        for name, first in FIRST_ROW.items():
            assert rows[name].first_valid_index() == first, name


def test_dense_prices_equal_the_kept_panel(spark, price_folder, panel_folder):
    dense = densify(read_prices(spark, price_folder, ["ALFA", "BETA"]))
    known = read_panel(spark, [f"{panel_folder}/{k}_processed.csv" for k in ("ALFA", "BETA")], "csv")
    known = known.select("Date", "Ticker", F.col("Close").alias("c"), F.col("Volume").alias("v"))
    both = dense.join(known, ["Date", "Ticker"], "full").where("Close = c and Volume = v")
    assert dense.count() == both.count() == 2 * 367


def test_row_positions_by_rank_give_the_same(spark, sample, panel_folder):
    ranked = add_indicators(read_panel(spark, panel_folder, "csv")).toPandas().sort_values(["Ticker", "Date"]).reset_index(drop=True)
    for name in ranked.columns[2:]:
        assert (ranked[name] - sample[name]).abs().max() < 1e-6 * max(1, sample[name].abs().max())


def test_correlation(spark, panel_folder, panel_frame):
    rows = add_indicators(read_panel(spark, panel_folder, "csv"), ["SMA_20", "SMA_50"], series=PANEL)
    names = ["Close", "Volume", "SMA_20", "SMA_50", "sentiment"]
    cells = {(c.Ticker, c.a, c.b): c.r for c in correlation_matrix(rows, names, by="Ticker").collect()}
    for key, own in panel_frame.groupby("Ticker"):
        own = own.reset_index(drop=True)
        want = own.assign(**expected(own)[["SMA_20", "SMA_50"]])[names].corr()
        for a in names:
            for b in names:
                assert cells[key, a, b] == pytest.approx(want.loc[a, b], abs=1e-9)


def test_distribution(spark, panel_folder, sample):
    rows = add_indicators(read_panel(spark, panel_folder, "csv"), ["Daily_Return"], series=PANEL)
    bounds = {b.Ticker: b for b in histogram_bounds(rows, "Daily_Return", by="Ticker").collect()}
    counts = histogram(rows, "Daily_Return", by="Ticker").toPandas()
    curves = kde(rows, "Daily_Return", 100, by="Ticker", cut=0.0, bins=40).toPandas()
    for key, own in sample.groupby("Ticker"):
        values = own.Daily_Return.dropna().to_numpy(float)
        n, width = len(values), np.ptp(values)
        quartiles = np.subtract(*np.percentile(values, [75, 25]))
        floor = max(2 * quartiles / n ** (1 / 3), width / (2 * np.sqrt(n)))
        assert bounds[key].bins == np.ceil(width / min(width / (np.log2(n) + 1), floor)) if quartiles > 0 else True
        want, _ = np.histogram(values, bounds[key].bins)
        assert list(counts[counts.Ticker == key].sort_values("bin")["count"]) == list(want)
        curve = curves[curves.Ticker == key].sort_values("point")
        h = values.std(ddof=1) * n**-0.2
        grid = np.linspace(values.min(), values.max(), 100)
        density = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).sum(axis=1) / (n * h * np.sqrt(2 * np.pi))
        np.testing.assert_allclose(curve.x, grid, atol=1e-12)
        np.testing.assert_allclose(curve.density, density, rtol=1e-9)
        np.testing.assert_allclose(curve.count_scaled, density * n * width / 40, rtol=1e-9)
