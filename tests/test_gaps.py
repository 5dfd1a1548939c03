"""Exponential means of series with gaps, against pandas and across small blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.ewm import ewm_means_over_gaps
from tidemark.operators.indicators import exponential_over_gaps
from tidemark.series import Series


def gappy(seed: int, keys: int = 3) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    parts = []
    for k in range(keys):
        n = int(rng.integers(1, 150))
        close = 100 + rng.normal(size=n).cumsum()
        close[rng.random(n) < rng.choice([0.1, 0.6, 1.0])] = np.nan
        parts.append(pd.DataFrame({"Date": pd.date_range("2020-01-01", periods=n).date, "Ticker": f"k{k}", "Close": close, "Volume": 1.0}))
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("seed,daily,block", [(1, True, 7), (2, False, 16), (3, True, 4096)])
def test_means_and_signal_equal_pandas(spark, seed, daily, block):
    frame = gappy(seed)
    rows = frame.astype(object).where(frame.notna(), None).values.tolist()
    df = spark.createDataFrame(rows, "Date date, Ticker string, Close double, Volume double").repartition(4)
    got = exponential_over_gaps(df, series=Series(daily=daily, block_rows=block)).toPandas().sort_values(["Ticker", "Date"])
    by = frame.groupby("Ticker").Close
    mean = lambda span: by.transform(lambda c: c.ewm(span=span, adjust=False).mean())
    macd = mean(12) - mean(26)
    signal = macd.groupby(frame.Ticker).transform(lambda c: c.ewm(span=9, adjust=False).mean())
    for name, want in {"EMA_20": mean(20), "MACD": macd, "Signal_Line": signal}.items():
        np.testing.assert_allclose(got[name].to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-9)
    assert len(got) == len(frame)


def test_a_large_old_value_is_not_cut_off(spark):
    """After a thousand rows a value of 1e30 still shows in a mean of ones."""
    df = spark.range(1200).select(
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("Date"),
        F.lit("a").alias("Ticker"), F.when(F.col("id") == 0, 1e30).otherwise(1.0).alias("x"), F.create_map(F.lit("m"), "id").alias("other"),
    )
    got = ewm_means_over_gaps(df, {"y": ("x", 26)}, Series(daily=True, block_rows=100)).orderBy("Date")
    y, want = got.toPandas().y.to_numpy(), [1e30]
    for _ in range(1199):
        want.append(25 / 27 * want[-1] + 2 / 27)
    np.testing.assert_allclose(y, want, rtol=1e-9)


def test_span_one_and_no_rows(spark):
    df = spark.createDataFrame([("2020-01-01", "a", 1.0), ("2020-01-02", "a", None), ("2020-01-03", "a", float("nan")), ("2020-01-04", "a", 4.0)], "d string, Ticker string, x double")
    df = df.select(F.col("d").cast("date").alias("Date"), "Ticker", "x")
    assert [r.y for r in ewm_means_over_gaps(df, {"y": ("x", 1)}).orderBy("Date").collect()] == [1.0, 1.0, 1.0, 4.0]
    assert ewm_means_over_gaps(df.limit(0), {"y": ("x", 5)}).collect() == []
