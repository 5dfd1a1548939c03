"""Rows of every series cut into fixed-size blocks, each padded with the rows before it.

A plain window over a key pulls the whole series of that key into one task. Here rows are
placed by (key, block), and the last ``halo`` rows before a block are copied into it, so any
window that looks back at most ``halo`` rows is answered inside the block. One shuffle serves
every such window. Running totals add a small per-block table, whose size per key is the row
count over ``block_rows``: with unique dates it cannot pass 892 rows in all years 1 to 9999.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.series import Series

POS = "_pos"
BLOCK = "_block"
HALO = "_halo"
REPEATS = "_repeats"


def known_rows(df: DataFrame, series: Series) -> DataFrame:
    """Rows that belong to a series: key and date are both known."""
    return df.where(F.col(series.key).isNotNull() & F.col(series.date).isNotNull())


def day_number(series: Series) -> Column:
    return F.unix_date(F.col(series.date).cast("date")).cast("long")


def whole_div(a: Column, n: int) -> Column:
    """Division rounded down, also below zero (days before 1970)."""
    return F.floor(a / F.lit(n)).cast("long")


def number_rows(df: DataFrame, series: Series) -> DataFrame:
    """Add the row position inside each series as ``_pos``.

    Only its differences matter. A daily series uses the day number. Otherwise rows are ranked
    inside calendar spans, and spans are offset by the row counts of earlier spans.
    """
    rows = known_rows(df, series)
    if series.daily:
        return rows.withColumn(POS, day_number(series))
    rows = rows.withColumn("_span", whole_div(day_number(series), series.block_rows))
    earlier = Window.partitionBy(series.key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(series.key, "_span")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(series.key, "_span", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    )
    in_span = Window.partitionBy(series.key, "_span").orderBy(series.date)
    return (
        rows.join(starts, [series.key, "_span"])
        .withColumn(POS, F.col("_start") + F.row_number().over(in_span) - 1)
        .drop("_span", "_start")
    )


def lay_out(df: DataFrame, halo: int, series: Series) -> DataFrame:
    """Add ``_pos``, ``_block`` and ``_halo``; copy rows that later blocks look back at."""
    rows = number_rows(df, series)
    own = whole_div(F.col(POS), series.block_rows)
    if halo == 0:
        return rows.withColumns({BLOCK: own, HALO: F.lit(False)})
    last = whole_div(F.col(POS) + halo, series.block_rows)
    return (
        rows.withColumn("_own", own)
        .withColumn(BLOCK, F.explode_outer(F.sequence("_own", last)))
        .withColumn(HALO, F.col(BLOCK) > F.col("_own"))
        .drop("_own")
    )


def place(laid: DataFrame, series: Series) -> DataFrame:
    """Shuffle by (key, block) now, for steps whose first window is finer than a block.

    Left to itself the planner would shuffle for the finer window, and again for the block.
    """
    return laid.repartition(series.key, BLOCK)


def block_window(series: Series) -> WindowSpec:
    return Window.partitionBy(series.key, BLOCK).orderBy(POS)


def so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def trim(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(POS, BLOCK, HALO, REPEATS)


def over_blocks(
    df: DataFrame,
    halo: int,
    *steps: Callable[[WindowSpec], dict[str, Column]],
    series: Series,
) -> DataFrame:
    """Add columns computed by windows that look back at most ``halo`` rows in total.

    Each step maps the block window to named columns; later steps may read earlier ones.
    """
    out = lay_out(df, halo, series)
    window = block_window(series)
    for step in steps:
        out = out.withColumns(step(window))
    return trim(out)


def with_carry(
    placed: DataFrame,
    laid: DataFrame,
    totals: dict[str, Column],
    carries: Callable[[WindowSpec, WindowSpec], dict[str, Column]],
    series: Series,
) -> DataFrame:
    """Join to each row what the earlier blocks of its key add up to.

    ``totals`` are aggregates of a block's own rows. ``carries`` builds columns from them, given
    the window of all earlier blocks and the plain window over the blocks of a key.

    ``laid`` has the rows of ``placed`` before the shuffle: totals are summed up there first, from the
    columns they need alone, and only rows per block travel.
    """
    per_block = laid.where(~F.col(HALO)).groupBy(series.key, BLOCK).agg(*[value.alias(name) for name, value in totals.items()])
    ordered = Window.partitionBy(series.key).orderBy(BLOCK)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    table = per_block.select(
        series.key, BLOCK, *[value.alias(name) for name, value in carries(earlier, ordered).items()]
    )
    return placed.join(table, [series.key, BLOCK], "left")


def attach_per_key(rows: DataFrame, per_key: DataFrame, series: Series, salts: int = 32) -> DataFrame:
    """Left join of one-row-per-key values that spreads the rows of a large key.

    The per-key side is repeated once per salt, so a key that holds most rows is joined in
    ``salts`` places. When the planner finds the side small enough, it broadcasts it instead.
    """
    salted = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        rows.withColumn("_salt", F.pmod(F.unix_date(F.col(series.date).cast("date")), F.lit(salts)))
        .join(salted, [series.key, "_salt"], "left")
        .drop("_salt")
    )
