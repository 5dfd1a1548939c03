"""Correlation, return distribution and density."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import nan_to_null, ratio
from tidemark.session import written

SALTS = 32
#: Bandwidths from a value beyond which its Gaussian kernel, below 3e-18 of its height, is left out of a density.
REACH = 9.0
#: Terms of the Hermite series of a cell; with cells of 1/sqrt(2) bandwidths what is left out is below 2e-14 of a kernel's height.
TERMS = 16
# Fixed values of 64-bit floating point numbers.
MANTISSA = 1 << 52
LEAST_NORMAL, LEAST_DOUBLE = 2.0**-1022, 2.0**-1074


def pearson(a: str, b: str) -> Column:
    """Correlation over the rows where both are known; NULL where one is constant."""
    x = F.when(F.col(b).isNotNull(), F.col(a))
    y = F.when(F.col(a).isNotNull(), F.col(b))
    return ratio(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def correlation_matrix(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Pairwise correlations as rows (a, b, r), in one pass over the data."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    grouped = df.groupBy(by) if by else df.groupBy()
    wide = grouped.agg(*[pearson(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("a"), F.lit(right).alias("b"), F.col(f"_{i}").alias("r")))
    keep = [by] if by else []
    return wide.select(*keep, F.explode(F.array(*cells)).alias("_cell")).select(*keep, "_cell.a", "_cell.b", "_cell.r")


def mean_of(df: DataFrame, c: str, by: str | None = None) -> DataFrame:
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(F.avg(c).alias(f"mean_{c}"))


def beside(rows: DataFrame, stats: DataFrame, by: str | None) -> DataFrame:
    """Put the one row of ``stats`` (per key, if ``by`` is given) next to every row.

    Overall statistics are a scalar subquery. Those per key are joined over salted copies, so the
    rows of a large key meet them in many places, equal values too.
    """
    if by is None:
        names = stats.columns
        return rows.withColumn("_stats", stats.select(F.struct(*names)).scalar()).select(*rows.columns, "_stats.*")
    salted = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return spread.join(salted, [by, "_salt"]).drop("_salt")


@dataclass(frozen=True)
class Measure:
    """Values of which some ranks are wanted. ``wanted`` makes an array of ranks (from 0) out of the total weights of all measures.

    A row counts ``weight`` times (once by default). Unknown values, NULL or NaN, and rows of weight 0 don't count.
    """

    value: Column
    wanted: Callable[..., Column] = lambda *totals: F.array().cast("array<bigint>")
    weight: Column | None = None


def ordered_bits(x: Column) -> Column:
    """A double as a whole number of 64 bits in the same order: its own bits, negated below zero. Both zeros are 0.

    The power of two is taken from a logarithm, which may be off by one, and set right by comparison. All
    multiplications are with powers of two, and so exact, for the smallest numbers and infinity too.
    """
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("int")
    near = F.pow(F.lit(2.0), guess)
    power = guess + F.when(size >= 2 * near, 1).when(size < near, -1).otherwise(0)
    mantissa = size / F.pow(F.lit(2.0), power) - 1
    normal = (power + 1023).cast("bigint") * F.lit(MANTISSA) + (mantissa * F.lit(float(MANTISSA))).cast("bigint")
    tiny = (size / F.lit(LEAST_DOUBLE)).cast("bigint")
    bits = F.when(size == math.inf, F.lit(2047 * MANTISSA)).when(size >= LEAST_NORMAL, normal).otherwise(tiny)
    return F.when(x < 0, -bits).otherwise(bits)


class Ranked:
    """Result of ``ranked_values``: ``frame`` has the keys, and ``at`` makes a column of the value at a rank."""

    def __init__(self, frame: DataFrame, measures: int):
        self.frame = frame
        self.totals = [F.col(f"_t{i}") for i in range(measures)]

    def at(self, rank: Column, measure: int = 0) -> Column:
        below = F.filter("_spots", lambda s: (s["m"] == measure) & (s["before"] <= rank))
        return F.when((rank >= 0) & (rank < self.totals[measure]), F.array_max(F.transform(below, lambda s: s["x"])))


def ranked_values(df: DataFrame, measures: list[Measure], by: str | None = None, stored: bool = False) -> Ranked:
    """The values at wanted ranks of some measures, all found in the same four readings, per key if ``by`` is given.

    Values are taken as ordered numbers of 64 bits, and each reading settles the next 16 bits of the wanted ranks' values: it
    counts the rows that agree in the bits settled so far. Only counts are shuffled, at most 65,536 per wanted rank and task;
    no job runs before the result is asked for, but for the copy of the values that is written unless ``df`` is ``stored`` anyway.
    """
    keys = [by] if by else []
    each = [F.struct(F.lit(i).alias("_m"), m.value.cast("double").alias("_x"), (F.lit(1) if m.weight is None else m.weight).cast("bigint").alias("_w")) for i, m in enumerate(measures)]
    rows = df.select(*keys, F.inline(F.array(*each))).where(F.col("_x").isNotNull() & ~F.isnan("_x") & (F.col("_w") > 0))
    rows = rows if stored else written(rows, "values")
    names = [f"_t{i}" for i in range(len(measures))]
    totals = [F.coalesce(F.sum(F.when(F.col("_m") == i, F.col("_w"))), F.lit(0)).alias(name) for i, name in enumerate(names)]
    whole = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("before")) for i in range(len(measures))])
    spots = rows.groupBy(*keys).agg(*totals).withColumn("_spots", whole)
    coded = rows.withColumn("_bits", ordered_bits(F.col("_x")))
    for shift in (48, 32, 16, 0):
        digits = F.shiftright("_bits", shift)
        settled = F.lit(0).cast("bigint") if shift == 48 else F.shiftright("_bits", shift + 16)
        placed = beside(coded.withColumns({"_at": digits, "_above": settled}).drop("_bits"), spots, by)
        held = F.filter("_spots", lambda s: (s["m"] == F.col("_m")) & (s["prefix"] == F.col("_above")))
        inside = placed.select(*keys, "_m", "_x", "_w", "_at", *names, F.explode(held).alias("_s"))
        counts = inside.groupBy(*keys, "_m", "_s.prefix", "_s.before", "_at").agg(
            F.sum("_w").alias("_n"), F.min("_x").alias("_x"), *[F.max(name).alias(name) for name in names]
        )
        upto = Window.partitionBy(*keys, "_m", "prefix").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        summed = counts.withColumn("_upto", F.col("before") + F.sum("_n").over(upto))
        ranks = F.lit(None).cast("array<bigint>")
        for i, measure in enumerate(measures):
            ranks = F.when(F.col("_m") == i, measure.wanted(*[F.col(name) for name in names]).cast("array<bigint>")).otherwise(ranks)
        hit = F.exists(ranks, lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n")))
        spot = F.struct(F.col("_m").alias("m"), F.col("_at").alias("prefix"), (F.col("_upto") - F.col("_n")).alias("before"), F.col("_x").alias("x"))
        spots = summed.where(hit).groupBy(*keys).agg(*[F.max(name).alias(name) for name in names], F.collect_list(spot).alias("_spots"))
    return Ranked(spots, len(measures))


def exact_quantiles(df: DataFrame, c: str, shares: list[float], by: str | None = None, stored: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation, one column ``q0, q1, ..`` per share; NULL between infinities of both signs."""
    low = lambda n, share: F.floor((n - 1) * share).cast("bigint")
    wanted = lambda n: F.array(*[low(n, share) + add for share in shares for add in (0, 1)])
    found = ranked_values(df, [Measure(F.col(c), wanted)], by, stored)
    n, columns = found.totals[0], []
    for i, share in enumerate(shares):
        first = found.at(low(n, share))
        after = F.coalesce(found.at(low(n, share) + 1), first)
        part = (n - 1) * share - low(n, share)
        between = F.when((first == after) | (part == 0), first).otherwise(first + (after - first) * part)
        columns.append(nan_to_null(between).alias(f"q{i}"))
    return found.frame.select(*([by] if by else []), *columns)


def middle(n: Column) -> Column:
    """Rank of the lower median of ``n`` values."""
    return F.floor((n - 1) / 2).cast("bigint")


def lower_median(df: DataFrame, c: str, by: str | None = None, stored: bool = False) -> DataFrame:
    """The exact lower median as column ``median``; over no known values it is NULL (one row), per key there is no row."""
    found = ranked_values(df, [Measure(F.col(c), lambda n: F.array(middle(n)))], by, stored)
    return found.frame.select(*([by] if by else []), found.at(middle(found.totals[0])).alias("median"))


def histogram_bounds(df: DataFrame, c: str, bins: int | str = "auto", by: str | None = None) -> DataFrame:
    """Smallest value, bin width and bin count, per key if ``by`` is given.

    ``auto`` takes the narrower of the Sturges and the Freedman-Diaconis width, the latter no
    narrower than range / (2 sqrt n); a zero quartile range leaves Sturges alone.
    """
    keys = [by] if by else []
    stats = df.where(F.col(c).isNotNull()).groupBy(*keys).agg(
        F.count(c).alias("_n"), F.min(c).alias("lo"), F.max(c).alias("hi")
    )
    spread = F.col("hi") - F.col("lo")
    if bins == "auto":
        quartiles = exact_quantiles(df, c, [0.25, 0.75], by)
        stats = stats.join(quartiles, by) if by else beside(stats, quartiles, None)
        sturges = spread / (F.log2("_n") + 1)
        freedman = F.greatest(2 * (F.col("q1") - F.col("q0")) / F.cbrt("_n"), spread / (2 * F.sqrt("_n")))
        width = F.when(F.col("q1") > F.col("q0"), F.least(sturges, freedman)).otherwise(sturges)
        count = F.greatest(F.ceil(F.try_divide(spread, width)), F.lit(1))
        count = F.coalesce(count, F.lit(1)).cast("long")
    else:
        count = F.lit(int(bins)).cast("long")
    stats = stats.withColumn("bins", count)
    return stats.select(*keys, "lo", "hi", "bins", (spread / F.col("bins")).alias("width"))


def histogram(df: DataFrame, c: str, bins: int | str = "auto", by: str | None = None) -> DataFrame:
    """Counts per bin (bin, left, right, count), empty bins included; the last bin is closed."""
    keys = [by] if by else []
    bounds = histogram_bounds(df, c, bins, by)
    known = df.where(F.col(c).isNotNull()).select(*keys, F.col(c).alias("_v"))
    placed = beside(known, bounds, by)
    inside = F.floor(F.try_divide(F.col("_v") - F.col("lo"), F.col("width")))
    bin_no = F.least(F.coalesce(inside, F.lit(0)), F.col("bins") - 1)
    counts = placed.groupBy(*keys, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = bounds.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)))
    return every.join(counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("left"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("right"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def power(x: Column, m: int) -> Column:
    """``x`` to a small whole power, by products."""
    if m == 0:
        return F.lit(1.0)
    half = power(x, m // 2)
    return half * half * x if m % 2 else half * half if m > 1 else x


def hermite_sum(factors: Column, z: Column) -> Column:
    """The sum of ``factors[m]`` times the m-th Hermite polynomial, times exp(-z^2), from the last term down."""
    start = F.struct(F.lit(0.0).alias("b"), F.lit(0.0).alias("after"), F.lit(TERMS).alias("above"))
    step = lambda s, a: F.struct(
        (a + 2 * z * s["b"] - 2 * s["above"] * s["after"]).alias("b"), s["b"].alias("after"), (s["above"] - 1).alias("above")
    )
    return F.exp(-z * z) * F.aggregate(F.reverse(factors), start, step, lambda s: s["b"])


def kde(
    df: DataFrame, c: str, grid: int = 200, by: str | None = None, cut: float = 3.0, bins: int | None = None
) -> DataFrame:
    """Gaussian kernel density on ``grid`` points (point, x, density).

    The bandwidth is s * n^(-1/5), and the grid covers ``cut`` bandwidths beyond the data: with 0 it
    ends where the data do. With ``bins`` the column ``count_scaled`` has the curve that fits a histogram
    of so many bins.

    A fast Gauss transform: values are put into cells of 1/sqrt(2) bandwidths, of which only ``TERMS``
    moments about the middle are kept, summed up before the shuffle. The Hermite series of a cell then
    gives its part of every grid point within ``REACH`` bandwidths. The work is a moment vector per
    value and a grid per cell; errors are below 2e-14 of the height of one value's kernel. Unknown
    values don't count, and where the bandwidth is unknown or 0, the density is NULL.
    """
    keys = [by] if by else []
    known = df.where(F.col(c).isNotNull()).select(*keys, F.col(c).cast("double").alias("_v"))
    stats = known.groupBy(*keys).agg(
        F.count("_v").alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.stddev_samp("_v").alias("_s")
    )
    width = F.col("_s") * F.pow(F.col("_all").cast("double"), F.lit(-0.2))
    setup = stats.withColumn("_h", width).select(
        *keys,
        "_all",
        "_h",
        "_lo",
        (F.col("_hi") - F.col("_lo")).alias("_range"),
        (F.col("_lo") - cut * F.col("_h")).alias("_from"),
        ((F.col("_hi") - F.col("_lo") + 2 * cut * F.col("_h")) / (grid - 1)).alias("_step"),
    )
    placed = beside(known, setup.select(*keys, "_lo", "_h"), by).where("_h > 0")
    place = (F.col("_v") - F.col("_lo")) / (F.col("_h") / math.sqrt(2))
    cells = placed.select(*keys, F.floor(place).alias("_cell"), (place - F.floor(place) - 0.5).alias("_u"))
    moments = cells.groupBy(*keys, "_cell").agg(*[F.sum(power(F.col("_u"), m)).alias(f"_m{m}") for m in range(TERMS)])
    # Moments by half cells, of width h / sqrt(2), become factors of the series in h * sqrt(2).
    factors = F.array(*[F.col(f"_m{m}") / (2.0**m * math.factorial(m)) for m in range(TERMS)])
    rows = beside(moments.select(*keys, "_cell", factors.alias("_factors")), setup, by)
    middle_of = F.col("_lo") + (F.col("_cell") + 0.5) * F.col("_h") / math.sqrt(2)
    spot = (middle_of - F.col("_from")) / F.col("_step")
    span = (REACH + 1) * F.col("_h") / F.col("_step")
    first = F.greatest(F.ceil(spot - span), F.lit(0)).cast("int")
    last = F.least(F.floor(spot + span), F.lit(grid - 1)).cast("int")
    near = F.when(first <= last, F.sequence(first, last))
    x = F.col("_from") + F.col("point") * F.col("_step")
    z = (x - middle_of) / (F.col("_h") * math.sqrt(2))
    part = hermite_sum(F.col("_factors"), F.col("_z")) / math.sqrt(2 * math.pi)
    near_cells = rows.withColumn("point", F.explode(near)).select(*keys, "point", "_factors", z.alias("_z"))
    sums = near_cells.groupBy(*keys, "point").agg(F.sum(part).alias("_sum"))
    every = setup.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    joined = every.join(sums, [*keys, "point"], "left")
    density = F.try_divide(F.when(F.col("_h") > 0, F.greatest(F.coalesce("_sum", F.lit(0.0)), F.lit(0.0))), F.col("_all") * F.col("_h"))
    scaled = [(density * F.col("_all") * F.col("_range") / bins).alias("count_scaled")] if bins else []
    return joined.select(*keys, "point", x.alias("x"), density.alias("density"), *scaled)
