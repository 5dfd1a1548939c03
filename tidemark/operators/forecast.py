"""Short forecasts of every series at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.blocks import attach_per_key, over_blocks
from tidemark.operators.features import lookback_blocks, windows_of
from tidemark.operators.rolling import diff, last_n, shift
from tidemark.series import SERIES, Series

STEPS = 7


def changes(df: DataFrame, price: str, series: Series) -> DataFrame:
    """Add the price change ``_d`` and the change before it ``_d_before``."""
    return over_blocks(
        df,
        2,
        lambda w: {"_d": diff(price, w)},
        lambda w: {"_d_before": shift("_d", 1, w)},
        series=series,
    )


def summed_path(drifts: Column, slope: Column, last_change: Column, steps: int) -> Column:
    """Sums of the forecast changes after each step; ``drifts`` holds one constant per step."""
    start = F.struct(last_change.alias("change"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("path"))

    def advance(state: Column, drift: Column) -> Column:
        change = drift + slope * state["change"]
        total = state["total"] + change
        return F.struct(
            change.alias("change"), total.alias("total"), F.concat(state["path"], F.array(total)).alias("path")
        )

    return F.aggregate(drifts, start, advance, lambda state: state["path"])


def stepped(df: DataFrame, path: Column, last: Column, steps: int, series: Series) -> DataFrame:
    """One row per key and step ahead from the summed changes."""
    return (
        df.select(series.key, "_last_day", last.alias("_price"), F.posexplode(path).alias("_at", "_sum"))
        .select(
            series.key,
            F.date_add("_last_day", F.col("_at") + 1).alias(series.date),
            (F.col("_at") + 1).alias("step"),
            (F.col("_price") + F.col("_sum")).alias("forecast"),
        )
    )


def ar_forecast(df: DataFrame, steps: int = STEPS, price: str = "Close", series: Series = SERIES) -> DataFrame:
    """Least-squares autoregression of the price changes, per key: (key, date, step, forecast).

    One aggregate gives slope, intercept and the last state of every key. Where the slope is
    undefined the mean change is continued.
    """
    rows = changes(df, price, series)
    fit = rows.groupBy(series.key).agg(
        F.regr_slope("_d", "_d_before").alias("_slope"),
        F.regr_intercept("_d", "_d_before").alias("_intercept"),
        F.avg("_d").alias("_mean"),
        F.max_by("_d", series.date).alias("_d_last"),
        F.max_by(price, series.date).alias("_last"),
        F.max(series.date).alias("_last_day"),
    )
    slope = F.coalesce(F.col("_slope"), F.lit(0.0))
    drift = F.coalesce(F.col("_intercept"), F.col("_mean"), F.lit(0.0))
    path = summed_path(F.array_repeat(drift, steps), slope, F.coalesce(F.col("_d_last"), F.lit(0.0)), steps)
    return stepped(fit, path, F.col("_last"), steps, series)


#: A pivot of the unit-variance system below this is none: the input depends on those already taken.
DEPENDENT = 1e-10


def swept(system: Column, size: int) -> Column:
    """Weights that solve a symmetric system of ``size`` rows, each with its right side behind it, by a fold over arrays.

    Each step takes the unused input with the largest remaining diagonal, and eliminates it from all other rows. Inputs
    whose diagonal is used up depend on the others, and get weight 0.
    """
    start = F.struct(system.alias("rows"), F.array_repeat(F.lit(False), size).alias("used"))

    def step(state: Column, _: Column) -> Column:
        left = F.transform(state["rows"], lambda row, i: F.struct(F.when(F.get(state["used"], i), -1.0).otherwise(F.get(row, i)).alias("d"), (-i).alias("i")))

        def eliminate(best: Column) -> Column:
            at = -best["i"]
            pivot = F.transform(F.get(state["rows"], at), lambda v: v / best["d"])

            def reduced(row: Column, i: Column) -> Column:
                return F.when(i == at, pivot).otherwise(F.zip_with(row, pivot, lambda v, p: v - F.get(row, at) * p))

            used = F.transform(state["used"], lambda u, i: u | (i == at))
            done = F.struct(F.transform(state["rows"], reduced).alias("rows"), used.alias("used"))
            return F.when(best["d"] > DEPENDENT, done).otherwise(state)

        # An array of one pivot, mapped over: so it is sought once, not once per use.
        return F.get(F.transform(F.array(F.array_max(left)), eliminate), F.lit(0))

    def weights(state: Column) -> Column:
        return F.transform(state["rows"], lambda row, i: F.when(F.get(state["used"], i), F.element_at(row, -1)).otherwise(0.0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(size)), start, step, weights)


def with_least_squares(fit: DataFrame, inputs: int) -> DataFrame:
    """Add ``_weights`` and ``_drift`` from ``_cov``, the upper triangle of covariances over the inputs and then the target, and the means ``_avg``.

    Inputs are scaled to unit variance first, so the size of their units doesn't matter.
    """
    size = inputs + 1
    place = {pair: n for n, pair in enumerate((i, j) for i in range(size) for j in range(i, size))}
    known = lambda i, j: F.coalesce(F.get("_cov", F.lit(place[min(i, j), max(i, j)])), F.lit(0.0))
    spreads = [F.when(known(i, i) > 0, F.sqrt(known(i, i))).otherwise(1.0) for i in range(size)]
    fit = fit.withColumn("_spread", F.array(*spreads))
    cell = lambda i, j: known(i, j) / (F.get("_spread", F.lit(i)) * F.get("_spread", F.lit(j)))
    fit = fit.withColumn("_system", F.array(*[F.array(*[cell(i, j) for j in range(size)]) for i in range(inputs)]))
    unit = F.transform(swept(F.col("_system"), inputs), lambda w, i: w * F.element_at("_spread", -1) / F.get("_spread", i))
    fit = fit.withColumn("_weights", unit)
    mean = lambda c: F.coalesce(c, F.lit(0.0))
    told = F.zip_with("_weights", F.slice("_avg", 1, inputs), lambda w, m: w * mean(m))
    drift = mean(F.element_at("_avg", -1)) - F.aggregate(told, F.lit(0.0), lambda s, v: s + v)
    return fit.withColumn("_drift", drift).drop("_system", "_spread")


def ar_exog_forecast(
    df: DataFrame, exog: list[str], steps: int = STEPS, price: str = "Close", series: Series = SERIES
) -> DataFrame:
    """As ``ar_forecast`` with further inputs; their last ``steps`` rows stand in for the future.

    One aggregate with partial sums gives all covariances of a key, and its small linear system is solved in the row. Of
    inputs that depend on each other, those taken later have no weight. A key with fewer rows than ``steps`` has its
    last row's inputs repeated, so there are always ``steps`` forecasts.
    """
    names = ["_d_before", *exog, "_d"]
    inputs = F.array(*[F.col(c).cast("double") for c in exog])
    df = df.na.fill(0.0, subset=exog)
    rows = changes(df, price, series)
    newest = last_n(df.select(series.key, series.date, *exog), steps, series).groupBy(series.key).agg(
        F.sort_array(F.collect_list(F.struct(series.date, inputs.alias("x")))).alias("_newest")
    )
    known = F.transform("_newest", lambda row: row["x"])
    future = F.concat(known, F.array_repeat(F.element_at(known, -1), steps - F.size(known)))
    newest = newest.select(F.col(series.key).alias("_own"), future.alias("_future"))
    complete = {c: F.when(F.col("_d_before").isNotNull(), F.col(c)) for c in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    fit = rows.groupBy(series.key).agg(
        F.array(*[F.covar_pop(complete[a], complete[b]) for a, b in pairs]).alias("_cov"),
        F.array(*[F.avg(complete[a]) for a in names]).alias("_avg"),
        F.max_by("_d", series.date).alias("_d_last"),
        F.max_by(price, series.date).alias("_last"),
        F.max(series.date).alias("_last_day"),
    )
    fit = fit.join(newest, fit[series.key].eqNullSafe(newest["_own"])).drop("_own")
    solved = with_least_squares(fit, len(names) - 1)
    weights = F.col("_weights")
    exog_weights = F.slice(weights, 2, len(exog))
    effect = F.transform(
        "_future",
        lambda future: F.col("_drift")
        + F.aggregate(F.zip_with(exog_weights, future, lambda g, x: g * x), F.lit(0.0), lambda s, v: s + v),
    )
    path = summed_path(effect, F.get(weights, F.lit(0)), F.coalesce(F.col("_d_last"), F.lit(0.0)), steps)
    return stepped(solved, path, F.col("_last"), steps, series)


@dataclass(frozen=True)
class LookbackModel:
    """Weights of the flattened look-back rows, oldest row first, and a constant."""

    coefficients: np.ndarray
    intercept: float


def fit_lookback(
    df: DataFrame, columns: list[str], target: str, length: int = 60, regularisation: float = 1e-6, series: Series = SERIES
) -> LookbackModel:
    """One linear model over the look-back rows of all keys, by least squares with a small weight on the squared coefficients.

    The windows of a block overlap, so their products are lagged ones: the products of a window's oldest row with each later one
    are summed up over all windows, and those of its other rows differ from these at the two ends of the block only. So
    each window adds ``length`` small products instead of one for every pair of its ``length * columns`` values.
    One row of sums per lag and column, and edges of as many rows as a window has pairs of rows, reach the driver, whatever the data.
    """
    size = len(columns)
    blocks = lookback_blocks(df, columns, target, length, series)
    products = lambda a, v: [F.sum(F.col(a) * F.get(v, F.lit(b))).alias(f"_p{b}") for b in range(size)]
    lagged = windows_of(blocks, length, series).select("y", F.get("X", F.lit(0)).alias("_old"), F.posexplode("X").alias("_lag", "_v"))
    lagged = lagged.select("y", "_lag", "_v", F.posexplode("_old").alias("_c", "_u"))
    own = F.get("_v", F.col("_c"))
    sums = lagged.groupBy(F.lit(-1).alias("_i"), "_lag", "_c").agg(
        *products("_u", "_v"), F.sum(own * F.col("y")).alias("_xy"), F.sum(own).alias("_x"), F.sum("y").alias("_y"), F.count("y").alias("_n")
    )

    def edge(i: Column) -> Column:
        count = F.lit(length - 1) - i
        return F.struct(i.alias("_i"), F.slice("_x", i + 1, count).alias("first"), F.slice("_x", F.size("_x") - length + i + 1, count).alias("last"))

    if length > 1:
        ends = blocks.select(F.inline(F.transform(F.sequence(F.lit(0), F.lit(length - 2)), edge)))
        both = F.array(F.struct(F.lit(-1.0).alias("sign"), F.col("first").alias("rows")), F.struct(F.lit(1.0).alias("sign"), F.col("last").alias("rows")))
        ends = ends.select("_i", F.inline(both)).select("_i", "sign", F.get("rows", F.lit(0)).alias("_old"), F.posexplode("rows").alias("_lag", "_v"))
        ends = ends.select("_i", "_lag", "_v", F.posexplode(F.transform("_old", lambda u: u * F.col("sign"))).alias("_c", "_u"))
        none = {name: F.lit(None) for name in ("_xy", "_x", "_y", "_n")}
        sums = sums.unionByName(ends.groupBy("_i", "_lag", "_c").agg(*products("_u", "_v")).withColumns(none))
    return _solved(sums.toPandas(), size, length, regularisation)


def _solved(sums: pd.DataFrame, size: int, length: int, regularisation: float) -> LookbackModel:
    """The normal equations put together from the sums of ``fit_lookback``, and their solution."""
    cells = np.zeros((length, length, size, size))  # oldest row of the pair less one, lag, column of each
    cells[(sums["_i"] + 1).to_numpy(), sums["_lag"].to_numpy(), sums["_c"].to_numpy()] = sums[[f"_p{b}" for b in range(size)]].to_numpy(float)
    cells = np.cumsum(cells, axis=0)
    whole = np.zeros((length, size, length, size))
    for i in range(length):
        for lag in range(length - i):
            whole[i, :, i + lag, :] = cells[i, lag]
            whole[i + lag, :, i, :] = cells[i, lag].T
    main = sums[sums["_i"] < 0].sort_values(["_lag", "_c"])
    n = int(main["_n"].iloc[0]) if len(main) else 0
    if not n:
        return LookbackModel(np.zeros(length * size), 0.0)
    mean_x, mean_y = main["_x"].to_numpy(float) / n, float(main["_y"].iloc[0]) / n
    covariance = whole.reshape(length * size, length * size) / n - np.outer(mean_x, mean_x)
    with_target = main["_xy"].to_numpy(float) / n - mean_x * mean_y
    weights = np.linalg.lstsq(covariance + regularisation * np.eye(length * size), with_target, rcond=None)[0]
    return LookbackModel(weights, mean_y - float(weights @ mean_x))


def lookback_residuals(model: LookbackModel, windows: DataFrame, length: int = 60) -> DataFrame:
    """(lag, column, mean): mean product of the model's residual with each input; all near 0 if it is a least-squares fit."""
    weights = F.array(*[F.lit(float(v)) for v in model.coefficients])
    products = F.zip_with(F.flatten("X"), weights, lambda value, weight: value * weight)
    residual = F.col("y") - F.aggregate(products, F.lit(float(model.intercept)), lambda s, v: s + v)
    size = len(model.coefficients) // length
    rows = windows.select(residual.alias("_r"), F.posexplode("X").alias("lag", "_row"))
    means = rows.groupBy("lag").agg(F.array(*[F.avg(F.col("_r") * F.get("_row", F.lit(b))) for b in range(size)]).alias("_means"))
    return means.select("lag", F.posexplode("_means").alias("column", "mean"))


def last_sequence(df: DataFrame, columns: list[str], length: int = 60, series: Series = SERIES) -> DataFrame:
    """The newest ``length`` rows per key as one array, oldest first: (key, date, X)."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    newest = last_n(df, length, series).groupBy(series.key).agg(
        F.max(series.date).alias(series.date),
        F.sort_array(F.collect_list(F.struct("step", values.alias("x")))).alias("_rows"),
    )
    return newest.where(F.size("_rows") == length).select(
        series.key, series.date, F.transform("_rows", lambda row: row["x"]).alias("X")
    )


def rollout(
    model: LookbackModel, sequences: DataFrame, steps: int = STEPS, target_at: int = 0, series: Series = SERIES
) -> DataFrame:
    """Predict ``steps`` ahead from the last sequence of each key, feeding predictions back.

    A new row repeats the last row, with the target replaced by the prediction.
    """
    weights = F.array(*[F.lit(float(v)) for v in model.coefficients])
    constant = F.lit(float(model.intercept))
    start = F.struct(F.col("X").alias("x"), F.array().cast("array<double>").alias("path"))

    def predict(x: Column) -> Column:
        products = F.zip_with(F.flatten(x), weights, lambda value, weight: value * weight)
        return F.aggregate(products, constant, lambda s, v: s + v)

    def advance(state: Column, _: Column) -> Column:
        # An array of one prediction, mapped over: so the prediction is made once, not once per use.
        def moved(value: Column) -> Column:
            last = F.element_at(state["x"], -1)
            row = F.concat(F.slice(last, 1, target_at), F.array(value), F.slice(last, target_at + 2, F.size(last)))
            rows = F.concat(F.slice(state["x"], 2, F.size(state["x"]) - 1), F.array(row))
            return F.struct(rows.alias("x"), F.concat(state["path"], F.array(value)).alias("path"))

        return F.get(F.transform(F.array(predict(state["x"])), moved), F.lit(0))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, advance, lambda state: state["path"])
    return sequences.select(series.key, series.date, F.posexplode(path).alias("_at", "forecast")).select(
        series.key,
        F.date_add(series.date, F.col("_at") + 1).alias(series.date),
        (F.col("_at") + 1).alias("step"),
        "forecast",
    )


def hold_out(df: DataFrame, steps: int = STEPS, series: Series = SERIES) -> tuple[DataFrame, DataFrame]:
    """Split off the newest ``steps`` rows of each key: (rows to fit on, rows to compare with)."""
    newest = last_n(df, steps, series)
    cut = newest.groupBy(series.key).agg(F.min(series.date).alias("_cut"))
    older = attach_per_key(df, cut, series).where(F.col(series.date) < F.col("_cut")).drop("_cut")
    return older, newest


def compare_forecast(actual: DataFrame, forecast: DataFrame, price: str = "Close", series: Series = SERIES) -> DataFrame:
    """Actual and forecast values of the same key and day, with the error."""
    known = actual.select(series.key, series.date, F.col(price).alias("actual"))
    return forecast.join(known, [series.key, series.date]).withColumn("error", F.col("forecast") - F.col("actual"))
