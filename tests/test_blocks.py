"""Results must not depend on where the blocks are cut: compared with pandas on random series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cumulative, ewm, features, rolling
from tidemark.operators.blocks import over_blocks
from tidemark.operators.calendar import densify
from tidemark.operators.indicators import PRICE_INDICATORS, add_indicators
from tidemark.series import Series

SMALL_BLOCKS = Series(block_rows=64)
DAILY_BLOCKS = Series(daily=True, block_rows=64)


def walk(length: int, seed: int, key: str, gaps: bool = False, start: str = "1969-11-20") -> pd.DataFrame:
    random = np.random.default_rng(seed)
    days = pd.date_range(start, periods=length)
    frame = pd.DataFrame(
        {
            "Date": days.date,
            "Ticker": key,
            "Close": 100 + random.normal(0, 1, length).cumsum(),
            "Volume": random.integers(1, 1000, length).astype(float),
        }
    )
    return frame[random.random(length) < 0.6].reset_index(drop=True) if gaps else frame


@pytest.fixture(scope="module")
def daily(spark):
    frame = pd.concat([walk(700, 1, "long"), walk(15, 2, "short"), walk(1, 3, "one")])
    return frame, spark.createDataFrame(frame).cache()


@pytest.fixture(scope="module")
def sparse(spark):
    frame = pd.concat([walk(900, 4, "long", gaps=True), walk(130, 5, "other", gaps=True)])
    return frame, spark.createDataFrame(frame).cache()


def by_key(frame: pd.DataFrame, compute) -> pd.Series:
    return pd.concat([compute(rows) for _, rows in frame.groupby("Ticker", sort=True)]).reset_index(drop=True)


def column(df, name: str) -> pd.Series:
    return df.toPandas().sort_values(["Ticker", "Date"])[name].astype(float).reset_index(drop=True)


def same(got: pd.Series, want: pd.Series, tolerance: float = 1e-9) -> None:
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=tolerance, atol=tolerance)


CASES = [("daily", DAILY_BLOCKS), ("daily", SMALL_BLOCKS), ("sparse", SMALL_BLOCKS)]


@pytest.mark.parametrize("data,series", CASES)
@pytest.mark.parametrize("n", [1, 5, 64, 150])
def test_rolling(request, data, series, n):
    frame, df = request.getfixturevalue(data)
    got = over_blocks(
        df,
        n - 1,
        lambda w: {"m": rolling.rolling_mean("Close", n, w), "lo": rolling.rolling_min("Close", n, w)},
        series=series,
    ).cache()
    assert got.count() == len(frame)
    same(column(got, "m"), by_key(frame, lambda f: f.Close.rolling(n).mean()))
    same(column(got, "lo"), by_key(frame, lambda f: f.Close.rolling(n).min()))


@pytest.mark.parametrize("data,series", CASES)
def test_shift_and_change(request, data, series):
    frame, df = request.getfixturevalue(data)
    got = over_blocks(
        df, 70, lambda w: {"s": rolling.shift("Close", 70, w), "p": rolling.pct_change("Close", w)}, series=series
    ).cache()
    same(column(got, "s"), by_key(frame, lambda f: f.Close.shift(70)))
    same(column(got, "p"), by_key(frame, lambda f: f.Close.pct_change()))


@pytest.mark.parametrize("data,series", CASES)
@pytest.mark.parametrize("span", [1, 2, 9, 26, 100])
def test_exponential_mean(request, data, series, span):
    frame, df = request.getfixturevalue(data)
    got = ewm.ewm_mean(df, "Close", span, "e", series)
    same(column(got, "e"), by_key(frame, lambda f: f.Close.ewm(span=span, adjust=False).mean()))


def test_exponential_mean_of_a_long_series(spark):
    frame = walk(6000, 6, "long")
    df = spark.createDataFrame(frame)
    for series in (Series(daily=True, block_rows=1024), Series()):
        got = ewm.ewm_means(df, {"a": ("Close", 20), "b": ("Close", 300)}, series).cache()
        same(column(got, "a"), frame.Close.ewm(span=20, adjust=False).mean())
        same(column(got, "b"), frame.Close.ewm(span=300, adjust=False).mean())


def test_exponential_mean_after_leading_nulls(spark):
    frame = walk(200, 7, "late")
    frame.loc[:119, "Close"] = np.nan
    df = spark.createDataFrame(frame).withColumn("Close", F.nanvl("Close", F.lit(None)))
    got = ewm.ewm_mean(df, "Close", 9, "e", DAILY_BLOCKS)
    same(column(got, "e"), frame.Close.ewm(span=9, adjust=False).mean())


@pytest.mark.parametrize("data,series", CASES)
@pytest.mark.parametrize("span", [1, 2, 20])
def test_exponential_mean_with_gaps(request, data, series, span):
    frame, df = request.getfixturevalue(data)
    day = pd.to_datetime(frame.Date)
    keep = (day.dt.day % 3 != 0) & (day.dt.month % 4 != 0) & (day > "1969-11-25")
    holes = frame.assign(Close=frame.Close.where(keep))
    gaps = (F.dayofmonth("Date") % 3 != 0) & (F.month("Date") % 4 != 0) & (F.col("Date") > "1969-11-25")
    dotted = df.withColumn("Close", F.when(gaps, F.col("Close")))
    want = by_key(holes, lambda f: f.Close.ewm(span=span, adjust=False).mean())
    same(column(ewm.ewm_mean_with_gaps(dotted, "Close", span, "e", series), "e"), want)
    plain = column(ewm.ewm_mean(dotted, "Close", span, "e", series), "e")
    assert span == 1 or (plain.isna() | np.isclose(plain, want)).all()


@pytest.mark.parametrize("data,series", CASES)
def test_running_values(request, data, series):
    frame, df = request.getfixturevalue(data)
    same(column(cumulative.cumsum(df, "Volume", "s", series), "s"), by_key(frame, lambda f: f.Volume.cumsum()))
    moved = df.withColumn("r", F.when(F.dayofmonth("Date") % 7 != 0, F.col("Close") / 10000))
    held = frame.assign(r=np.where(pd.to_datetime(frame.Date).dt.day % 7 != 0, frame.Close / 10000, np.nan))
    got = cumulative.cumreturn(moved, {"c": "r"}, series)
    same(column(got, "c"), by_key(held, lambda f: (1 + f.r).cumprod() - 1), 1e-8)
    gaps = df.withColumn("Close", F.when(F.dayofyear("Date") % 100 < 5, F.col("Close")))
    holes = frame.assign(Close=frame.Close.where(pd.to_datetime(frame.Date).dt.dayofyear % 100 < 5))
    same(column(cumulative.ffill(gaps, ["Close"], series), "Close"), by_key(holes, lambda f: f.Close.ffill()))


def test_densify_across_blocks(sparse):
    frame, df = sparse
    days = pd.date_range(frame.Date.min(), frame.Date.max())
    want = by_key(
        frame, lambda f: f.assign(Date=pd.to_datetime(f.Date)).set_index("Date").Close.reindex(days).ffill()
    )
    got = densify(df, series=SMALL_BLOCKS)
    same(column(got, "Close"), want)
    holes = densify(df, fill=False, series=SMALL_BLOCKS)
    assert holes.where("Close is not null").count() == len(frame)
    assert holes.count() == len(want)


@pytest.mark.parametrize("data,series", CASES)
def test_indicators_do_not_depend_on_blocks(request, data, series):
    _, df = request.getfixturevalue(data)
    small = add_indicators(df, series=series).toPandas().sort_values(["Ticker", "Date"])
    whole = add_indicators(df).toPandas().sort_values(["Ticker", "Date"])
    for name in PRICE_INDICATORS:
        same(small[name], whole[name], 1e-7)


@pytest.mark.parametrize("data,series", CASES)
def test_lookback(request, data, series):
    frame, df = request.getfixturevalue(data)
    rows = features.lookback(df, ["Close", "Volume"], "Close", 30, series).toPandas()
    assert len(rows) == sum(max(0, n - 30) for n in frame.groupby("Ticker").size())
    long = frame[frame.Ticker == "long"].reset_index(drop=True)
    for _, row in rows[rows.Ticker == "long"].iloc[::50].iterrows():
        at = long.index[long.Date == row.Date][0]
        np.testing.assert_allclose(np.array([list(x) for x in row.X])[:, 0], long.Close[at - 30 : at])
        assert row.y == pytest.approx(long.Close[at])


def test_last_n_across_blocks(daily):
    frame, df = daily
    got = rolling.last_n(df, 100, SMALL_BLOCKS).toPandas().sort_values(["Ticker", "Date"])
    want = frame.sort_values(["Ticker", "Date"]).groupby("Ticker").tail(100)
    assert list(got.Date) == list(want.Date)
    assert got.groupby("Ticker").step.max().to_dict() == {"long": 100, "short": 15, "one": 1}
