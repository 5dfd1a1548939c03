"""Gap-free daily calendars, and series laid on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import BLOCK, HALO, POS, REPEATS, block_window, day_number, lay_out, place, so_far, trim, whole_div, with_carry
from tidemark.series import SERIES, Series


def keys_df(spark: SparkSession, keys: list[str], key: str = "Ticker") -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias(key))


def first_and_last_day(df: DataFrame, date: str = "Date") -> tuple[Column, Column]:
    """Overall first and last date, as scalar subqueries inside the plan."""
    return df.select(F.min(date)).scalar(), df.select(F.max(date)).scalar()


def calendar(df: DataFrame, date: str = "Date") -> DataFrame:
    """Every day from the first to the last date, both included."""
    return df.agg(F.min(date).alias("_lo"), F.max(date).alias("_hi")).select(
        F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 day"))).alias(date)
    )


def horizon(df: DataFrame, steps: int, series: Series = SERIES) -> DataFrame:
    """The ``steps`` days after the last day of each key."""
    return (
        df.groupBy(series.key)
        .agg(F.max(series.date).alias("_last"))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
        .select(series.key, "step", F.date_add("_last", F.col("step")).alias(series.date))
    )


def densify(
    df: DataFrame,
    values: tuple[str, ...] = ("Close", "Volume"),
    keys: list[str] | None = None,
    fill: bool = True,
    observed_default: dict[str, Column] | None = None,
    span: tuple[Column, Column] | None = None,
    series: Series = SERIES,
    halo: int | None = None,
) -> DataFrame:
    """One row per key and day between the overall first and last date.

    Each observed row is stretched over the days up to the next observed row, so the calendar is
    never multiplied with the keys or joined to the data. With ``fill`` the stretched days carry
    the last known value; otherwise they are NULL. Days before the first row of a key are NULL.
    ``keys`` selects keys, and adds those without any row. ``observed_default`` replaces NULLs
    of observed rows that have no earlier value to carry. ``span`` gives the first and last day
    when the caller knows a cheaper way to them. With ``halo`` the days come laid out for windows that
    look back at most so many rows (``lay_out_days``).
    """
    stretched = stretch(df, values, keys, fill, span, series)
    if halo is None:
        return spread_days(stretched, values, keys, fill, observed_default, series)
    return lay_out_days(stretched, halo, values, fill, observed_default, series)


def stretch(
    df: DataFrame,
    values: tuple[str, ...] = ("Close", "Volume"),
    keys: list[str] | None = None,
    fill: bool = True,
    span: tuple[Column, Column] | None = None,
    series: Series = SERIES,
) -> DataFrame:
    """One row per observed row and key, with the days it stands for: from ``_from`` until the day before ``_until``.

    With ``fill`` values are carried forward. ``_low`` and ``_high`` have the first and last day of all. A listed key
    without rows has one row with no date and no values.
    """
    key, date = series.key, series.date
    observed = df.where(F.col(date).isNotNull()).select(date, key, *values)
    observed = observed.where(F.col(key).isin(keys) if keys is not None else F.col(key).isNotNull())
    low, high = span or first_and_last_day(observed, date)
    day_series = series.as_daily()

    rows = lay_out(observed, 0, day_series)
    laid = with_carry(
        place(rows, day_series),
        rows,
        {
            "_first": F.min(date),
            **{f"_end_{v}": F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(POS))) for v in values},
        },
        lambda earlier, ordered: {
            "_next_block": F.lead("_first").over(ordered),
            "_opens": F.lag(BLOCK).over(ordered).isNull(),
            **{f"_carry_{v}": F.last(f"_end_{v}", ignorenulls=True).over(earlier) for v in values},
        },
        day_series,
    )
    w = block_window(day_series)
    carried = {
        v: F.coalesce(*([F.last(v, ignorenulls=True).over(so_far(w)), F.col(f"_carry_{v}")] if fill else [F.col(v)]))
        for v in values
    }
    stretched = laid.withColumns(
        {
            **carried,
            "_until": F.coalesce(F.lead(date).over(w), F.col("_next_block"), F.date_add(high, 1)),
            "_from": F.when(F.col("_opens") & F.lag(date).over(w).isNull(), low).otherwise(F.col(date)),
        }
    )
    rows = trim(stretched).select(date, key, *values, "_from", "_until")
    if keys is None:
        return rows
    absent = keys_df(df.sparkSession, keys, key).distinct().join(observed.select(key).distinct(), key, "left_anti")
    kinds = dict(rows.dtypes)
    empty = absent.select(
        F.lit(None).cast(kinds[date]).alias(date),
        key,
        *[F.lit(None).cast(kinds[v]).alias(v) for v in values],
        low.cast(kinds["_from"]).alias("_from"),
        F.date_add(high, 1).alias("_until"),
    )
    return rows.unionByName(empty)


def spread_days(
    stretched: DataFrame,
    values: tuple[str, ...] = ("Close", "Volume"),
    keys: list[str] | None = None,
    fill: bool = True,
    observed_default: dict[str, Column] | None = None,
    series: Series = SERIES,
) -> DataFrame:
    """One row per day out of what ``stretch`` returns (``keys`` and ``fill`` as there)."""
    key, date = series.key, series.date
    days = with_defaults(stretched, observed_default, date).where(F.col("_from") < F.col("_until")).withColumn(
        "_day", F.explode(F.sequence("_from", F.date_sub("_until", 1), F.expr("interval 1 day")))
    )
    holds = F.col("_day") >= F.col(date) if fill else F.col("_day") == F.col(date)
    return days.select(F.col("_day").alias(date), key, *[F.when(holds, F.col(v)).alias(v) for v in values])


def with_defaults(stretched: DataFrame, observed_default: dict[str, Column] | None, date: str) -> DataFrame:
    defaults = observed_default or {}
    return stretched.withColumns({v: F.when(F.col(date).isNotNull(), F.coalesce(F.col(v), default)) for v, default in defaults.items()})


def lay_out_days(
    stretched: DataFrame,
    halo: int,
    values: tuple[str, ...] = ("Close", "Volume"),
    fill: bool = True,
    observed_default: dict[str, Column] | None = None,
    series: Series = SERIES,
) -> DataFrame:
    """The rows of ``spread_days`` as ``lay_out`` and ``place`` leave them: with ``_pos``, ``_block`` and ``_halo``.

    What is shuffled are the stretched rows, cut where a block or the days it looks back at begin and end. Days are made
    inside the blocks, from rows in order, so that sorting them finds them sorted. ``_repeats`` marks days with the finite
    or NULL values of the day before, but none that begin a block.
    """
    key, date, n = series.key, series.date, series.block_rows
    kind = dict(stretched.dtypes)[date]
    first, last = F.unix_date(F.col("_from").cast("date")).cast("long"), F.unix_date(F.col("_until").cast("date")).cast("long") - 1
    known = with_defaults(stretched, observed_default, date).where(F.col("_from") < F.col("_until"))
    pieces = (
        known.select(date, key, *values, first.alias("_first"), last.alias("_last"))
        .withColumn(BLOCK, F.explode(F.sequence(whole_div(F.col("_first"), n), whole_div(F.col("_last") + halo, n))))
        .withColumns({
            "_start": F.greatest(F.col("_first"), F.col(BLOCK) * n - halo),
            "_end": F.least(F.col("_last"), F.col(BLOCK) * n + (n - 1)),
        })
        .select(date, key, *values, BLOCK, "_start", "_end")
    )
    # A set number: by their size, pieces would be put together into few tasks, in which several times as many days are sorted.
    tasks = int(stretched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = pieces.repartition(tasks, key, BLOCK).sortWithinPartitions(key, BLOCK, "_start")
    days = placed.withColumn(POS, F.explode(F.sequence("_start", "_end")))
    day = F.date_from_unix_date(F.col(POS).cast("int")).cast(kind)
    holds = day >= F.col(date) if fill else day == F.col(date)
    steady = [F.coalesce(~F.isnan(F.col(v).cast("double") * 0), F.lit(True)) for v in values]
    opened = F.coalesce(F.col(POS) != day_number(series), F.lit(True))
    repeats = (F.col(POS) > F.col("_start")) & opened & (F.col(POS) != F.col(BLOCK) * n)
    if not fill:
        repeats = repeats & F.coalesce(F.col(POS) != day_number(series) + 1, F.lit(True))
    for one in steady:
        repeats = repeats & one
    return days.select(
        day.alias(date), key, *[F.when(holds, F.col(v)).alias(v) for v in values], POS, BLOCK, (F.col(POS) < F.col(BLOCK) * n).alias(HALO), repeats.alias(REPEATS)
    )


def with_warmup(df: DataFrame, start: str, rows: int, series: Series = SERIES) -> DataFrame:
    """A daily panel from ``rows`` days before ``start``: enough for windows of that length.

    Filter to ``start`` again after computing; a filter on the date alone would starve the windows.
    """
    return df.where(F.col(series.date) >= F.date_sub(F.lit(start).cast("date"), rows))
