"""Panels that are laid out while their days are made, and rounding without decimals."""

import math
import random

import pytest
from paths import SMALL
from pyspark.sql import functions as F

from tidemark.functions.numbers import rounded
from tidemark.operators.calendar import densify
from tidemark.operators.indicators import PRICE_INDICATORS, add_indicators, look_back
from tidemark.plans.queries import QUERIES, level
from tidemark.series import Series

WINDOWED = ["SMA_20", "SMA_50", "RSI", "ATR", "OBV", "Stochastic_K"]
SCHEMA = "Date date, Ticker string, Close double, Volume double"


def observed(spark, odd=()):
    """Three keys with gaps of one to forty days, unknown and equal prices, one key that begins late; days before 1970 too."""
    dice = random.Random(7)
    rows = []
    for key, day in (("A", 0), ("B", 3), ("C", 150)):
        while day < 260:
            price = None if dice.random() < 0.1 else dice.choice([10.0, 12.5, 9.75, 31.0, *odd])
            rows.append((day - 120, key, price, float(dice.randint(1, 9))))
            day += dice.choice([1, 1, 2, 3, 7, 40])
    raw = spark.createDataFrame(rows, "day int, Ticker string, Close double, Volume double")
    return raw.select(F.date_from_unix_date("day").alias("Date"), "Ticker", "Close", "Volume")


def plain(rows):
    show = lambda v: "-" if v is None else "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return sorted((r.Ticker, str(r.Date), *[show(v) for k, v in r.asDict().items() if k not in ("Ticker", "Date")]) for r in rows)


@pytest.mark.parametrize("block_rows", [8, 64, 4096])
@pytest.mark.parametrize("how", [{}, {"fill": False}, {"default": 5.0}, {"keys": ["A", "C", "absent"]}], ids=str)
def test_a_laid_panel_has_the_same_indicators(spark, block_rows, how):
    how = {k: v for k, v in how.items() if k != "default"} | ({"observed_default": {"Close": F.lit(how["default"])}} if "default" in how else {})
    series, halo = Series(daily=True, block_rows=block_rows), look_back(WINDOWED)
    want = add_indicators(densify(observed(spark), series=series, **how), WINDOWED, series=series)
    got = add_indicators(densify(observed(spark), series=series, halo=halo, **how), WINDOWED, series=series, halo=halo)
    assert got.dtypes == want.dtypes
    assert plain(got.collect()) == plain(want.collect())


def test_infinite_prices_of_a_laid_panel(spark):
    """A day that repeats an infinite price has an unknown change, not none."""
    rows, series = observed(spark, [math.inf]), Series(daily=True, block_rows=64)
    want = add_indicators(densify(rows, series=series), ["OBV"], series=series).collect()
    assert any(math.isnan(r.OBV) for r in want)
    assert plain(add_indicators(densify(rows, series=series, halo=1), ["OBV"], series=series, halo=1).collect()) == plain(want)


def test_exponential_means_of_a_laid_panel(spark):
    series, halo = Series(daily=True), look_back(PRICE_INDICATORS)
    rows = observed(spark).where("Close IS NOT NULL")
    want = add_indicators(densify(rows, series=series), series=series)
    assert plain(add_indicators(densify(rows, series=series, halo=halo), PRICE_INDICATORS, series=series, halo=halo).collect()) == plain(want.collect())


def test_too_short_a_halo_is_told(spark):
    with pytest.raises(ValueError, match="19 are needed"):
        add_indicators(densify(observed(spark), halo=5), ["SMA_20"], halo=5)


def test_supplier_days_are_made_after_the_last_shuffle(spark):
    """What is sent are stretched rows, not days; days are windowed where they are made."""
    plan = QUERIES["supplier_indicators"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    from_windows_to_days = plan[plan.index(" Window [") : plan.index("Generate explode")]
    assert "Exchange" not in from_windows_to_days


@pytest.mark.parametrize("places", [2, 4, 6])
def test_rounded_is_what_decimals_round_to(spark, places):
    dice = random.Random(places)
    values = [dice.choice([1, -1]) * dice.randrange(10**9) / 10 ** dice.randrange(9) for _ in range(20_000)]
    values += [k / 10 ** (places + 1) + e for k in range(-105, 106, 5) for e in (0.0, 1e-12, -1e-12, 4e-7, -6e-7)]
    values += [None, 0.0, -0.0, -1e-9, 1e9, 123456789012.34567, 1e13, 1e300, 5e-324, math.inf, -math.inf, math.nan]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    off = rows.select("v", F.round("v", places).alias("a"), rounded("v", places, F.round("v", places)).alias("b")).where("NOT a <=> b")
    assert off.collect() == []


def test_rounded_levels(spark):
    dice = random.Random(1)
    values = [dice.randrange(10**9) / dice.choice([3e3, 7e4, 8e4, 4e5, 1.2e6]) for _ in range(50_000)]
    values += [k / 1e5 + e for k in range(-105, 106, 5) for e in (0.0, 4e-7, -4e-7, 5e-7, -5e-7, 6e-7, -6e-7)] + [1e13, -1e15]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert rows.select("v", level("v").alias("a"), rounded("v", 4, level("v")).alias("b")).where("NOT a <=> b").collect() == []
