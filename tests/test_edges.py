"""Hand-made edge cases: gaps, late keys, flat and rising series, odd dates and texts."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clean_text, parse_date
from tidemark.operators import aggregates, cumulative, features, filling, forecast, statistics
from tidemark.operators.calendar import densify
from tidemark.operators.indicators import add_indicators, rsi_flags
from tidemark.operators.sentiment import WORDS, lexicon_score
from tidemark.plans.panels import dense_prices, panel_driven, tweet_driven
from tidemark.series import PANEL

START = dt.date(2024, 1, 1)


def days(values, key="A", volume=1.0):
    return [(START + dt.timedelta(i), key, None if v is None else float(v), volume) for i, v in enumerate(values)]


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame(rows, "Date date, Ticker string, Close double, Volume double")


def listed(df, name, key="A"):
    return [r[name] for r in df.where(F.col("Ticker") == key).orderBy("Date").collect()]


def test_leading_gap_is_filled_by_scope(frame):
    rows = days([1, 2, 3, 4], "A") + [r for r in days([None, None, 30, 40], "B") if r[2]]
    dense = densify(frame(rows))
    assert listed(dense, "Close", "B") == [None, None, 30, 40]
    assert listed(filling.fill_residual(dense, "none"), "Close", "B")[:2] == [None, None]
    assert listed(filling.fill_residual(dense, "global"), "Close", "B")[:2] == [3, 3]
    assert listed(filling.fill_residual(dense, "key"), "Close", "B")[:2] == [30, 30]
    assert listed(filling.fill_residual(dense, "global"), "Volume", "B") == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        filling.fill_residual(dense, "other")


def test_interior_gap_and_null_carry_the_last_value(frame):
    rows = days([1, None, 3, 4, 5])
    del rows[3]
    assert listed(densify(frame(rows)), "Close") == [1, 1, 3, 3, 5]
    assert listed(densify(frame(rows), fill=False), "Close") == [1, None, 3, None, 5]


def test_nan_counts_as_missing_and_ticks_are_averaged(frame):
    rows = days([1, math.nan, 3]) + [(START, "A", 5.0, 3.0)]
    daily = aggregates.daily_mean(frame(rows))
    assert listed(daily, "Close") == [3, None, 3]
    assert listed(daily, "Volume") == [2, 1, 1]


def test_key_without_data(frame):
    dense = filling.fill_residual(densify(frame(days([1, 2, 9])), keys=["A", "Z"]))
    assert listed(dense, "Close", "Z") == [2, 2, 2]
    assert listed(dense, "Volume", "Z") == [0, 0, 0]


def test_other_columns_stay(frame):
    rows = frame(days([1, 2, 3])).withColumn("note", F.create_map(F.lit("a"), F.lit("b")))
    summed = cumulative.cumsum(rows, "Close", "total")
    assert listed(summed, "total") == [1, 3, 6]
    assert listed(summed, "note") == [{"a": "b"}] * 3
    assert "note" in add_indicators(rows, ["OBV", "EMA_20"]).columns


def test_one_day_and_no_rows(frame):
    assert densify(frame(days([7]))).collect() == [(START, "A", 7.0, 1.0)]
    assert densify(frame([])).collect() == []
    assert add_indicators(frame([])).collect() == []


def test_flat_series(frame):
    rows = add_indicators(frame(days([5] * 30)), series=PANEL)
    assert set(listed(rows, "RSI")) == {None}
    assert set(listed(rows, "Stochastic_K")) == {None}
    assert listed(rows, "BB_upper")[-1] == listed(rows, "BB_lower")[-1] == 5
    assert set(listed(rows, "OBV")) == {0}
    cells = statistics.correlation_matrix(rows, ["Close", "Volume"]).collect()
    assert len(cells) == 4 and all(c.r is None for c in cells)
    assert {r.Close for r in features.minmax_scale(rows.select("Date", "Ticker", "Close"), ["Close"]).collect()} == {0}


def test_rising_series(frame):
    rows = add_indicators(frame(days(range(1, 31))), series=PANEL)
    assert listed(rows, "RSI") == [None] * 13 + [100] * 17
    assert listed(rows, "Stochastic_K")[13:] == [100] * 17
    assert listed(rsi_flags(rows), "RSI_flag")[12:14] == [None, "overbought"]
    assert listed(rows, "ATR")[13:15] == [None, 1]


def test_zero_price_before(frame):
    rows = add_indicators(frame(days([0, 3, 6])), ["Daily_Return"], series=PANEL)
    assert listed(rows, "Daily_Return") == [None, None, 1]


@pytest.mark.parametrize("length", [1, 13, 14, 15])
def test_short_series(frame, length):
    rows = add_indicators(frame(days(range(1, length + 1))), series=PANEL)
    assert sum(v is not None for v in listed(rows, "RSI")) == max(0, length - 13)
    assert sum(v is not None for v in listed(rows, "ATR")) == max(0, length - 14)
    assert sum(v is not None for v in listed(rows, "MACD")) == length


def test_unknown_names_and_missing_columns(frame):
    with pytest.raises(ValueError):
        add_indicators(frame(days([1])), ["SMA_21"])
    with pytest.raises(ValueError):
        add_indicators(frame(days([1])), ["Sentiment_7D_Rolling"])
    with pytest.raises(ValueError):
        cumulative.benchmark_compare(frame(days([1])))


def test_dates(spark):
    df = spark.createDataFrame([("31/12/2020",), ("2020-12-31",), ("not a date",), (None,), ("1/2/2020",)], "d string")
    got = [r[0] for r in df.select(parse_date("d", dayfirst=True)).collect()]
    assert got == [dt.date(2020, 12, 31)] * 2 + [None, None, dt.date(2020, 2, 1)]


def test_cleaning(spark):
    df = spark.createDataFrame([("Hello, World! 42",), (None,), ("",), ("a b c",), ("É-x_y",)], "t string")
    got = [r[0] for r in df.select(clean_text("t")).collect()]
    assert got == ["hello world 42", "", "", "a b c", "xy"]


def test_scores(spark):
    texts = ["", None, "?!...", "good", "not good", "very good", "dont say it is good", "bad but good", "nothing known here x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, tweet string")
    plain = {r.id: r.sentiment for r in lexicon_score(df, id="id").collect()}
    ruled = {r.id: r.sentiment for r in lexicon_score(df, id="id", negation=True).collect()}
    squeeze = lambda s: round(s / math.sqrt(s * s + 15), 4)
    assert [plain[i] for i in (0, 1, 2, 8)] == [0, 0, 0, 0]
    assert plain[3] == plain[4] == plain[5] == squeeze(1.9)
    assert ruled[4] == squeeze(-0.74 * 1.9)
    assert ruled[5] == squeeze(1.9 + 0.293)
    assert ruled[6] == ruled[3] == squeeze(1.9)
    assert ruled[7] == squeeze(-2.5 * 0.5 + 1.9 * 1.5)


def test_own_lexicon_and_texts_without_id(spark):
    lexicon = spark.createDataFrame([("moon", 3.0)], "token string, valence double")
    df = spark.createDataFrame([("to the moon",), ("to the moon",), ("down",)], "tweet string")
    got = sorted(r.sentiment for r in lexicon_score(df, lexicon=lexicon).collect())
    assert got == [0, 0.6124, 0.6124]


@pytest.fixture(scope="module")
def tweets(spark):
    rows = [
        (START, "A", "good"), (START, "A", "bad"), (START + dt.timedelta(1), "A", "great"),
        (START + dt.timedelta(90), "A", "good"), (START, "unknown", "good"),
    ]
    return spark.createDataFrame(rows, "Date date, Ticker string, tweet string")


def test_panel_driven(frame, tweets):
    rows = panel_driven(frame(days([1, 2, 3])), tweets, keys=["A"])
    assert listed(rows, "Close") == [1, 2, 3]
    assert rows.count() == 3
    scores = listed(rows, "sentiment")
    assert scores[0] == pytest.approx((0.4404 - 0.5423) / 2, abs=1e-9) and scores[2] == 0


def test_tweet_driven(frame, tweets):
    rows = tweet_driven(frame(days([1, 2, 3])), tweets, keys=["A"])
    assert listed(rows, "Close") == [1, 2, None]
    assert rows.count() == 3


def test_first_prices_missing_take_the_median(frame, tweets):
    rows = panel_driven(frame(days([None, 4, 6])), tweets, keys=["A"])
    assert listed(rows, "Close") == [4, 4, 6]


WORDS_AND_MODIFIERS = [
    "good day", "not good", "very good but bad", "", None, "good good bad", "it is never very terrible", "but good but bad",
    "kinda weak, hardly a win", "nothing here", "don't win", "best BEST best"
]


@pytest.mark.parametrize("negation", [False, True])
def test_scores_do_not_depend_on_ids_or_shuffles(spark, negation):
    """One row per text after a shuffle, without any id; a lexicon that is joined gives what a held one does."""
    rows = [(t,) for t in WORDS_AND_MODIFIERS] * 5
    texts = spark.createDataFrame(rows, "tweet string").repartition(7)
    plain = sorted(r.sentiment for r in lexicon_score(texts, negation=negation).collect())
    assert len(plain) == len(rows)
    lexicon = spark.createDataFrame([*WORDS.items(), ("o'clock\\", 1.0), (None, 1.0), ("odd", None)], "token string, valence double")
    held = sorted(r.sentiment for r in lexicon_score(texts, lexicon=lexicon, negation=negation).collect())
    joined = sorted(r.sentiment for r in lexicon_score(texts, lexicon=lexicon, negation=negation, held_entries=3).collect())
    assert plain == held == joined
    assert sum(score != 0 for score in plain) == 5 * sum("here" not in (t or "here") and t != "" for t in WORDS_AND_MODIFIERS)


def test_repeated_ids_keep_their_rows(spark):
    texts = spark.createDataFrame([(1, "good"), (1, "bad"), (None, "good")], "n int, tweet string")
    rows = lexicon_score(texts, id="n").collect()
    assert sorted(r.sentiment > 0 for r in rows) == [False, True, True]


def test_exact_quantiles(spark):
    import numpy as np

    values = [float(v) for v in np.random.default_rng(0).normal(size=999)] + [0.0] * 500
    df = spark.createDataFrame([(v, "ab"[i % 2]) for i, v in enumerate(values)], "v double, k string")
    got = statistics.exact_quantiles(df, "v", [0.25, 0.5, 0.9]).collect()[0]
    assert list(got) == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.9])))
    for row in statistics.exact_quantiles(df, "v", [0.25, 0.75], by="k").collect():
        own = [v for i, v in enumerate(values) if "ab"[i % 2] == row.k]
        assert [row.q0, row.q1] == pytest.approx(list(np.quantile(own, [0.25, 0.75])))
    for few in ([3.0], [1.0, 2.0], [5.0, 5.0, 5.0]):
        df = spark.createDataFrame([(v,) for v in few], "v double")
        got = statistics.exact_quantiles(df, "v", [0.25, 0.75]).collect()[0]
        assert list(got) == pytest.approx(list(np.quantile(few, [0.25, 0.75])))


def test_quantiles_of_uneven_magnitudes(spark):
    """Two huge outliers, tiny and negative values, and one value that a third of over a million rows have."""
    import numpy as np

    rows = spark.range(1_100_000).select(
        F.when(F.col("id") == 0, 1e300).when(F.col("id") == 1, -1e20).when(F.col("id") % 3 == 0, 0.0)
        .when(F.col("id") % 7 == 0, -1e-300 * F.col("id")).otherwise(F.sin(F.col("id").cast("double"))).alias("v")
    )
    values = np.sort(rows.toPandas().v.to_numpy())
    got = statistics.exact_quantiles(rows, "v", [0.0, 0.25, 0.4, 0.75, 1.0]).collect()[0]
    assert list(got) == list(np.quantile(values, [0.0, 0.25, 0.4, 0.75, 1.0]))
    assert statistics.lower_median(rows, "v").collect()[0].median == values[(len(values) - 1) // 2]
    assert statistics.lower_median(rows.where("v > 1e301"), "v").collect()[0].median is None


def test_ranks_of_odd_numbers(spark):
    """Both zeros, the smallest and largest numbers, infinities, and NaN, which counts as unknown."""
    import random

    values = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308, math.inf, -math.inf, 1.0, 1 - 2.0**-53, 2.0, -1e-310]
    values += [math.ldexp(1.0, e) for e in range(-1074, 1024, 37)] + [math.nextafter(math.ldexp(1.0, e), 0) for e in range(-1070, 1024, 41)]
    random.Random(2).shuffle(values)
    df = spark.createDataFrame([(v,) for v in [*values, math.nan, None]], "v double").repartition(3)
    ranks = F.sequence(F.lit(0).cast("bigint"), F.lit(len(values) - 1).cast("bigint"))
    found = statistics.ranked_values(df, [statistics.Measure(F.col("v"), lambda n: ranks)])
    listed = found.frame.select(F.explode(ranks).alias("rank"), "*").select("rank", found.at(F.col("rank")).alias("v")).orderBy("rank").collect()
    assert [row.v for row in listed] == sorted(values)
    bits = [row[0] for row in df.where("v is not null and not isnan(v)").orderBy("v").select(statistics.ordered_bits(F.col("v"))).collect()]
    assert bits == sorted(bits)
    got = statistics.exact_quantiles(df, "v", [0.0, 0.5, 1.0]).first()
    assert (got.q0, got.q2) == (-math.inf, math.inf)
    between = spark.createDataFrame([(-math.inf,), (math.inf,)], "v double")
    assert statistics.exact_quantiles(between, "v", [0.5]).first().q0 is None
    assert statistics.lower_median(spark.createDataFrame([(math.nan,)], "v double"), "v").first().median is None


def test_weighted_ranks_of_several_columns(spark):
    rows = [("a", float(i % 7), float(-i), i % 4) for i in range(200)] + [("b", 1.0, None, 2), ("b", None, 3.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double, w int")
    half = lambda n: F.array(F.floor(n / 2).cast("bigint"))
    measures = [statistics.Measure(F.col("x"), lambda n, m: half(n), F.col("w")), statistics.Measure(F.col("y"), lambda n, m: half(m))]
    found = statistics.ranked_values(df, measures, by="k")
    n, m = found.totals
    got = {r.k: (r.x, r.y) for r in found.frame.select("k", found.at(F.floor(n / 2)).alias("x"), found.at(F.floor(m / 2), 1).alias("y")).collect()}
    for key in "ab":
        x = sorted(v for k, v, _, w in rows if k == key and v is not None for _ in range(w or 0))
        y = sorted(v for k, _, v, _ in rows if k == key and v is not None)
        assert got[key] == (x[len(x) // 2], y[len(y) // 2])


def test_no_job_runs_before_a_median_is_asked_for(spark):
    """A written table's median is four readings inside the plan."""
    rows = spark.range(1000).select((F.col("id") * 1.5).alias("v"))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    median = statistics.lower_median(rows, "v", stored=True)
    assert len(tracker.getJobIdsForGroup(None)) == before
    assert median.first().median == 499 * 1.5


@pytest.mark.parametrize("seed", range(6))
def test_both_medians_of_a_panel(spark, seed):
    """Against lists: the first of carried rows, the second of days, with the first in place of what is unknown."""
    import random

    rng = random.Random(seed)
    days_of = {key: sorted(rng.sample(range(1, 40), rng.randint(1, 12))) for key in "ABC"}
    share = rng.choice([0.3, 0.8, 1.0])
    prices = {key: {day: rng.choice([None, float("nan")]) if rng.random() < share else float(rng.randint(1, 9)) for day in days} for key, days in days_of.items()}
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(day), key, price, 1.0) for key, own in prices.items() for day, price in own.items()]
    frame = spark.createDataFrame(rows, "Date date, Ticker string, Close double, Volume double")
    carried = {}
    for key, own in prices.items():
        last = None
        for day in days_of[key]:
            last = own[day] if own[day] is not None and own[day] == own[day] else last
            carried[key, day] = last
    middle = lambda values: sorted(values)[(len(values) - 1) // 2] if values else None
    first = middle([v for v in carried.values() if v is not None])
    low, high = min(d[0] for d in days_of.values()), max(d[-1] for d in days_of.values())
    panel = {}
    for key in "ABC":
        last = None
        for day in range(low, high + 1):
            if (key, day) in carried:
                last = first if carried[key, day] is None else carried[key, day]
            panel[key, day] = last
    second = middle([v for v in panel.values() if v is not None])
    got = {(r.Ticker, (r.Date - dt.date(2020, 1, 1)).days): r.Close for r in dense_prices(frame).collect()}
    assert got == {at: second if v is None else v for at, v in panel.items()}


def test_dependent_inputs_have_no_weight(frame):
    """The same input twice, in other units and constant: forecasts as with it alone."""
    import random

    rng = random.Random(1)
    prices = [100.0]
    for _ in range(60):
        prices.append(prices[-1] + rng.gauss(0, 1))
    rows = frame(days(prices)).withColumn("x", F.col("Close") % 7)
    alone = [r.forecast for r in forecast.ar_exog_forecast(rows, ["x"], 5, series=PANEL).orderBy("step").collect()]
    doubled = rows.withColumns({"y": 1e6 * F.col("x") - 3, "z": F.lit(4.0)})
    both = [r.forecast for r in forecast.ar_exog_forecast(doubled, ["x", "y", "z"], 5, series=PANEL).orderBy("step").collect()]
    assert both == pytest.approx(alone, rel=1e-9)


def test_swept_systems_equal_a_solver(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    for size in (1, 4, 9):
        a = rng.normal(size=(30, size))
        system, right = a.T @ a / 30, rng.normal(size=size)
        rows = [[*map(float, row), float(b)] for row, b in zip(system, right)]
        got = spark.createDataFrame([(rows,)], "m array<array<double>>").select(forecast.swept(F.col("m"), size).alias("w")).first().w
        np.testing.assert_allclose(got, np.linalg.solve(system, right), rtol=1e-8)


def test_short_series_have_all_steps(frame):
    rows = frame(days([5, 6, 8, 9])).withColumn("x", F.lit(1.0))
    assert forecast.ar_exog_forecast(rows, ["x"], 7, series=PANEL).count() == 7


def test_straight_line_continues_straight(frame):
    rows = forecast.ar_forecast(frame(days(range(10, 40))), series=PANEL).orderBy("step").collect()
    assert [r.forecast for r in rows] == pytest.approx(list(range(40, 47)))
    assert rows[0].Date == START + dt.timedelta(30)
    one = forecast.ar_forecast(frame(days([8])), series=PANEL).collect()
    assert {r.forecast for r in one} == {8}


def test_inputs_explain_the_change(frame):
    import numpy as np

    random = np.random.default_rng(3)
    x = random.normal(size=120)
    close = 100 + np.cumsum(0.5 + 2 * x)
    rows = frame(days(close)).withColumn("x", F.lit(0.0))
    driver = dict(zip([START + dt.timedelta(i) for i in range(120)], x.tolist()))
    pairs = rows.sparkSession.createDataFrame(list(driver.items()), "Date date, x double")
    joined = rows.drop("x").join(pairs, "Date")
    got = forecast.ar_exog_forecast(joined, ["x"], 3, series=PANEL).orderBy("step").collect()
    want = close[-1] + np.cumsum(0.5 + 2 * x[-3:])
    assert [r.forecast for r in got] == pytest.approx(list(want), rel=1e-6)


def test_all_model_inputs_against_a_direct_solution(spark, panel_folder):
    import numpy as np

    from tidemark.operators.indicators import MODEL_FEATURES
    from tidemark.sources import read_panel

    panel = read_panel(spark, f"{panel_folder}/BETA_processed.csv", "csv")
    rows = add_indicators(panel, MODEL_FEATURES, series=PANEL).na.fill(0.0)
    got = forecast.ar_exog_forecast(rows, MODEL_FEATURES, 7, series=PANEL).orderBy("step").toPandas().forecast
    table = rows.toPandas().sort_values("Date").reset_index(drop=True)
    change = table.Close.diff()
    inputs = np.column_stack([np.ones(len(table)), change.shift(1), table[MODEL_FEATURES]])[2:]
    scale = np.abs(inputs).max(axis=0)
    weights = np.linalg.lstsq(inputs / scale, change[2:], rcond=None)[0] / scale
    last, price, want = change.iloc[-1], table.Close.iloc[-1], []
    for future in table[MODEL_FEATURES].to_numpy()[-7:]:
        last = weights[0] + weights[1] * last + future @ weights[2:]
        price += last
        want.append(price)
    assert list(got) == pytest.approx(want, rel=1e-6)


def test_hold_out_compares_the_same_days(frame):
    older, newest = forecast.hold_out(frame(days(range(1, 31))), 7, PANEL)
    compared = forecast.compare_forecast(newest, forecast.ar_forecast(older, series=PANEL)).collect()
    assert len(compared) == 7
    assert max(abs(r.error) for r in compared) < 1e-9


def test_recursive_prediction(spark, frame):
    rows = frame(days(range(1, 101)))
    model = forecast.fit_lookback(rows, ["Close"], "Close", 5, series=PANEL)
    got = forecast.rollout(model, forecast.last_sequence(rows, ["Close"], 5), 3).orderBy("step").collect()
    assert [r.forecast for r in got] == pytest.approx([101, 102, 103], rel=1e-3)
