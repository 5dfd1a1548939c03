"""Running values: the part inside the block combined with the carry of earlier blocks.

Only the order of rows matters here, so blocks are calendar spans whether or not days are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import as_column
from tidemark.operators.blocks import HALO, block_window, lay_out, over_blocks, place, so_far, trim, with_carry
from tidemark.operators.rolling import pct_change
from tidemark.series import SERIES, Series


def ffill(df: DataFrame, columns: list[str], series: Series = SERIES) -> DataFrame:
    """Carry the last known value forward in each column; leading NULLs stay."""
    series = series.as_daily()
    rows = lay_out(df, 0, series)
    laid = with_carry(
        place(rows, series),
        rows,
        {f"_end_{c}": F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_pos"))) for c in columns},
        lambda earlier, _: {f"_carry_{c}": F.last(f"_end_{c}", ignorenulls=True).over(earlier) for c in columns},
        series,
    )
    running = so_far(block_window(series))
    filled = {
        c: F.coalesce(F.last(c, ignorenulls=True).over(running), F.col(f"_carry_{c}")) for c in columns
    }
    return trim(laid.withColumns(filled)).drop(*[f"_carry_{c}" for c in columns])


def running_sum(placed: DataFrame, sums: dict[str, str | Column], series: Series, laid: DataFrame | None = None) -> DataFrame:
    """Running sums over placed rows; NULL where the input is NULL.

    ``laid`` has the same rows before they were placed, where the input doesn't depend on that.
    """
    own = ~F.col(HALO)
    laid = with_carry(
        placed,
        placed if laid is None else laid,
        {f"_total_{out}": F.sum(as_column(c)) for out, c in sums.items()},
        lambda earlier, _: {f"_carry_{out}": F.sum(f"_total_{out}").over(earlier) for out in sums},
        series,
    )
    running = so_far(block_window(series))
    added = {
        out: F.when(
            as_column(c).isNotNull(),
            F.coalesce(F.col(f"_carry_{out}"), F.lit(0.0)) + F.sum(F.when(own, as_column(c))).over(running),
        )
        for out, c in sums.items()
    }
    return laid.withColumns(added).drop(*[f"_carry_{out}" for out in sums])


def cumsum(df: DataFrame, c: str, out: str, series: Series = SERIES) -> DataFrame:
    series = series.as_daily()
    rows = lay_out(df, 0, series)
    return trim(running_sum(place(rows, series), {out: c}, series, rows))


def cumreturn(df: DataFrame, returns: dict[str, str], series: Series = SERIES) -> DataFrame:
    """Compounded return so far, per entry ``{out: return column}``; NULL returns are skipped."""
    series = series.as_daily()
    rows = lay_out(df, 0, series)
    laid = with_carry(
        place(rows, series),
        rows,
        {f"_total_{out}": F.product(1 + F.col(r)) for out, r in returns.items()},
        lambda earlier, _: {f"_carry_{out}": F.product(F.col(f"_total_{out}")).over(earlier) for out in returns},
        series,
    )
    running = so_far(block_window(series))
    added = {
        out: F.when(
            F.col(r).isNotNull(),
            F.coalesce(F.col(f"_carry_{out}"), F.lit(1.0)) * F.product(1 + F.col(r)).over(running) - 1,
        )
        for out, r in returns.items()
    }
    return trim(laid.withColumns(added)).drop(*[f"_carry_{out}" for out in returns])


def benchmark_compare(panel: DataFrame, price: str = "Close", benchmark: str = "Benchmark_Close", series: Series = SERIES) -> DataFrame:
    """Daily and compounded returns of a series next to those of its benchmark."""
    if benchmark not in panel.columns:
        raise ValueError(f"column {benchmark} is missing: call attach_benchmark first")
    with_returns = over_blocks(
        panel,
        1,
        lambda w: {"Stock_Return": pct_change(price, w), "Benchmark_Return": pct_change(benchmark, w)},
        series=series,
    )
    return cumreturn(
        with_returns,
        {"Stock_Cumulative_Return": "Stock_Return", "Benchmark_Cumulative_Return": "Benchmark_Return"},
        series,
    )
