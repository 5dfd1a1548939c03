"""Exponentially weighted mean without recursion: y0 = x0, y = q*y + (1-q)*x, q = 1 - 2/(span+1).

After ``reach(span)`` rows a past value weighs less than 1e-18. That is below what a double can show
unless the old values are larger than the later ones by more than that factor; such a series isn't for
these functions.
So a block padded with that many rows gives the full result, and inside it the mean is a running
sum of x * q^-offset over spans of at least that length, plus the end of the span before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.numbers import nan_to_null
from tidemark.operators.blocks import BLOCK, POS, block_window, lay_out, number_rows, place, so_far, trim, whole_div
from tidemark.operators.cumulative import ffill
from tidemark.series import SERIES, Series

NEGLIGIBLE = math.log(1e18)
LARGEST_EXPONENT = 600.0


def decay(span: float) -> float:
    if span < 1:
        raise ValueError("span must be at least 1")
    return 1.0 - 2.0 / (span + 1.0)


def reach(span: float) -> int:
    q = decay(span)
    return 0 if q == 0 else math.ceil(NEGLIGIBLE / -math.log(q))


def share_stretches(spans: list[float]) -> dict[float, int]:
    """Length of the running-sum stretch for each span, shared where the powers stay in range."""
    lengths: dict[float, int] = {}
    current = 0
    for span in sorted({s for s in spans if decay(s) > 0}, reverse=True):
        if current == 0 or -math.log(decay(span)) * current > LARGEST_EXPONENT:
            current = 1 << (reach(span) - 1).bit_length()
        lengths[span] = current
    return lengths


def local_sums(means: dict[str, tuple[str, float]], series: Series) -> dict[str, Column]:
    """Weighted running sums inside each stretch of rows, one per mean."""
    lengths = share_stretches([span for _, span in means.values()])
    columns = {}
    for out, (c, span) in means.items():
        q = decay(span)
        if q == 0:
            continue
        offset = F.pmod(F.col(POS), F.lit(lengths[span]))
        stretch = F.floor(F.col(POS) / lengths[span])
        running = so_far(Window.partitionBy(series.key, BLOCK, stretch).orderBy(POS))
        weighted = (1 - q) * F.col(c) * F.pow(F.lit(q), -offset)
        columns[f"_local_{out}"] = F.sum(weighted).over(running) * F.pow(F.lit(q), offset)
    return columns


def carried_over(means: dict[str, tuple[str, float]], w: WindowSpec) -> dict[str, Column]:
    """Windows over the whole block: the end of the stretch before, and where each input starts."""
    lengths = share_stretches([span for _, span in means.values()])
    running = so_far(w)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    columns = {}
    for out, (c, span) in means.items():
        x = F.col(c)
        if decay(span) == 0:
            columns[f"_held_{out}"] = F.last(x, ignorenulls=True).over(running)
            continue
        is_end = F.pmod(F.col(POS), F.lit(lengths[span])) == lengths[span] - 1
        columns[f"_carried_{out}"] = F.last(F.when(is_end, F.col(f"_local_{out}")), ignorenulls=True).over(before)
        columns[f"_start_{c}"] = F.first(x, ignorenulls=True).over(running)
        columns[f"_since_{c}"] = F.first(F.when(x.isNotNull(), F.col(POS)), ignorenulls=True).over(running)
        columns[f"_known_{c}"] = F.count(x).over(running)
    return columns


def combined(means: dict[str, tuple[str, float]]) -> dict[str, Column]:
    """The means, from the local sums, the stretch before, and the start value of the series."""
    lengths = share_stretches([span for _, span in means.values()])
    columns = {}
    for out, (c, span) in means.items():
        q = decay(span)
        if q == 0:
            columns[out] = F.col(f"_held_{out}")
            continue
        offset = F.pmod(F.col(POS), F.lit(lengths[span]))
        start, age = F.col(f"_start_{c}"), F.col(POS) - F.col(f"_since_{c}")
        columns[out] = F.when(
            start.isNotNull() & (F.col(f"_known_{c}") == age + 1),
            F.coalesce(F.col(f"_local_{out}"), F.lit(0.0))
            + F.coalesce(F.col(f"_carried_{out}"), F.lit(0.0)) * F.pow(F.lit(q), offset + 1)
            + start * F.pow(F.lit(q), age + 1),
        )
    return columns


def ewm_means(df: DataFrame, means: dict[str, tuple[str, float]], series: Series = SERIES) -> DataFrame:
    """Add exponentially weighted means, per entry ``{out: (column, span)}``.

    NULLs may only lead a series: where a later one is within reach, the mean is NULL. Fill such gaps
    first, or use ``ewm_mean_with_gaps``.
    """
    halo = max(reach(span) for _, span in means.values())
    laid = place(lay_out(df, halo, series), series).withColumns(local_sums(means, series))
    out = laid.withColumns(carried_over(means, block_window(series))).withColumns(combined(means))
    return trim(out).select(*[c for c in df.columns if c not in means], *means)


def ewm_mean(df: DataFrame, c: str, span: float, out: str, series: Series = SERIES) -> DataFrame:
    return ewm_means(df, {out: (c, span)}, series)


def ewm_mean_with_gaps(df: DataFrame, c: str, span: float, out: str, series: Series = SERIES) -> DataFrame:
    """Exponentially weighted mean of a series with NULLs anywhere.

    After a gap the old mean has faded by q per row passed, and the two weights are scaled to sum
    to one; rows without a value repeat the mean before. Fading is kept as a running sum of
    logarithms, and stretches are cut where it passes a fixed amount.
    """
    q = decay(span)
    if q == 0:
        return ffill(df.withColumn(out, F.col(c)), [out], series)
    log_q, alpha = math.log(q), 1 - q
    key, date = series.key, series.date
    observed = number_rows(df.select(key, date, c), series).where(F.col(c).isNotNull()).withColumnRenamed(POS, "_row")
    laid = place(lay_out(observed, reach(span), Series(key, date, False, series.block_rows)), series)

    w = block_window(series)
    gap = F.col("_row") - F.lag("_row").over(w)
    faded = F.pow(F.lit(q), F.col("_gap"))
    laid = laid.withColumn("_gap", gap).withColumns(
        {
            "_weight": F.when(F.col("_gap").isNull(), 1.0).otherwise(alpha / (faded + alpha)),
            "_fade": F.when(F.col("_gap").isNull(), 0.0).otherwise(F.log(faded + alpha) - F.col("_gap") * log_q),
        }
    )
    laid = laid.withColumn("_total", F.sum("_fade").over(so_far(w)))
    laid = laid.withColumn("_stretch", F.floor(F.col("_total") / NEGLIGIBLE))
    since_cut = F.col("_total") - F.col("_stretch") * NEGLIGIBLE
    within = so_far(Window.partitionBy(key, BLOCK, "_stretch").orderBy(POS))
    laid = laid.withColumn("_local", F.sum(F.col("_weight") * F.col(c) * F.exp(since_cut)).over(within) * F.exp(-since_cut))
    is_end = F.lead("_stretch").over(w) != F.col("_stretch")
    laid = laid.withColumn("_end", F.when(is_end, F.struct("_local", "_total")))
    before = F.last("_end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    laid = laid.withColumn("_before", before)
    carried = F.col("_before._local") * F.exp(F.col("_before._total") - F.col("_total"))
    means = trim(laid.withColumn(out, F.col("_local") + F.coalesce(carried, F.lit(0.0)))).select(key, date, out)
    return ffill(df.join(means, [key, date], "left").select(*df.columns, out), [out], series)


def ewm_means_over_gaps(df: DataFrame, means: dict[str, tuple[str, float]], series: Series = SERIES) -> DataFrame:
    """Add exponentially weighted means of series with NULLs anywhere, by the recursion itself, per entry ``{out: (column, span)}``.

    After a gap the old mean has faded by q per row passed, and both weights are scaled to sum to one; rows without a
    value repeat the mean before. So each row changes the mean y to a * y + b, and so does a block as a whole: blocks are
    summed up to their (a, b) first, these are put together in order, at most 892 per key, and each block then
    starts from the mean it is handed. Nothing before a block is copied into it, and no old value is cut off. NaN counts as NULL.
    """
    key, rates = series.key, [decay(span) for _, span in means.values()]
    values = F.array(*[nan_to_null(F.col(c).cast("double")) for c, _ in means.values()])
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in means])
    rows = number_rows(df, series).select(F.col(key).alias("_key"), whole_div(F.col(POS), series.block_rows).alias(BLOCK), F.struct(F.col(POS).alias("pos"), values.alias("v"), kept.alias("row")).alias("_r"))
    in_order = lambda c: F.array_sort(c, lambda a, b: (a["pos"] - b["pos"]).cast("int"))
    blocks = rows.groupBy("_key", BLOCK).agg(in_order(F.collect_list("_r")).alias("_rows"))
    unknown, nowhere = F.lit(None).cast("double"), F.lit(None).cast("bigint")

    def faded(q: float, gap: Column) -> Column:
        f = F.pow(F.lit(q), gap)
        return f / (f + (1 - q))

    def moved(q: float, y: Column, at: Column, x: Column, pos: Column) -> Column:
        """The mean after one more row: (y, at)."""
        a = faded(q, pos - at)
        new = F.when(y.isNull(), x).otherwise(a * y + (1 - a) * x)
        return F.struct(F.coalesce(new, y).alias("y"), F.when(x.isNotNull(), pos).otherwise(at).alias("at"))

    def summed(state: Column, r: Column) -> Column:
        parts = []
        for i, q in enumerate(rates):
            s, x = state[f"m{i}"], F.get(r["v"], F.lit(i))
            a = faded(q, r["pos"] - s["at"])
            begun = s["first"].isNotNull()
            new = F.struct(
                F.coalesce(s["first"], r["pos"]).alias("first"),
                F.coalesce(s["x"], x).alias("x"),
                F.when(begun, a * s["a"]).otherwise(1.0).alias("a"),
                F.when(begun, a * s["b"] + (1 - a) * x).otherwise(0.0).alias("b"),
                r["pos"].alias("at"),
            )
            parts.append(F.when(x.isNull(), s).otherwise(new).alias(f"m{i}"))
        return F.struct(*parts)

    empty = F.struct(nowhere.alias("first"), unknown.alias("x"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), nowhere.alias("at"))
    whole = F.aggregate("_rows", F.struct(*[empty.alias(f"m{i}") for i in range(len(rates))]), summed)
    start = F.struct(*[F.struct(unknown.alias("y"), nowhere.alias("at")).alias(f"m{i}") for i in range(len(rates))])

    def handed_on(state: Column, block: Column) -> Column:
        parts = []
        for i, q in enumerate(rates):
            s, b = state["now"][f"m{i}"], block["s"][f"m{i}"]
            first = moved(q, s["y"], s["at"], b["x"], b["first"])["y"]
            after = F.struct((b["a"] * first + b["b"]).alias("y"), b["at"].alias("at"))
            parts.append(F.when(b["first"].isNull(), s).otherwise(after).alias(f"m{i}"))
        told = F.concat(state["told"], F.array(F.struct(block["pos"].alias(BLOCK), state["now"].alias("_in"))))
        return F.struct(F.struct(*parts).alias("now"), told.alias("told"))

    summaries = blocks.select("_key", F.struct(F.col(BLOCK).alias("pos"), whole.alias("s")).alias("_b")).groupBy("_key").agg(in_order(F.collect_list("_b")).alias("_bs"))
    kind = F.array().cast(f"array<struct<{BLOCK}:bigint,_in:struct<{','.join(f'm{i}:struct<y:double,at:bigint>' for i in range(len(rates)))}>>>")
    told = F.aggregate("_bs", F.struct(start.alias("now"), kind.alias("told")), handed_on, lambda state: state["told"])
    entries = summaries.select("_key", F.inline(told))

    def walked(state: Column, r: Column) -> Column:
        parts = [moved(q, state["now"][f"m{i}"]["y"], state["now"][f"m{i}"]["at"], F.get(r["v"], F.lit(i)), r["pos"]).alias(f"m{i}") for i, q in enumerate(rates)]
        now = F.struct(*parts)
        return F.struct(now.alias("now"), F.concat(state["ys"], F.array(F.array(*[p["y"] for p in [now[f"m{i}"] for i in range(len(rates))]]))).alias("ys"))

    ys = F.aggregate("_rows", F.struct(F.col("_in").alias("now"), F.array().cast("array<array<double>>").alias("ys")), walked, lambda state: state["ys"])
    done = blocks.join(entries, ["_key", BLOCK]).select(F.col("_rows.row").alias("_rows"), ys.alias("_ys"))
    each = done.select(F.inline(F.arrays_zip("_rows", "_ys")))
    return each.select("_rows.*", *[F.get("_ys", F.lit(i)).alias(out) for i, out in enumerate(means)])


def chained(outer: float, inner: float, mean_outer: Column, mean_inner: Column) -> Column:
    """ewm(outer) applied to ewm(inner), from the two single means of the same input.

    Two different first-order smoothers in a row are a weighted difference of the two
    smoothers alone, so the chain needs no second pass.
    """
    p, q = decay(outer), decay(inner)
    if p == q:
        raise ValueError("spans must differ")
    return (mean_outer * (p * (1 - q)) - mean_inner * (q * (1 - p))) / (p - q)
