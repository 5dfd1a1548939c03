from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.blocks import BLOCK, day_number, whole_div
from tidemark.series import SERIES, Series

# Columns of a panel, and the names its sources give them.
PANEL_SCHEMA = "Date date, Ticker string, Close double, Volume double, sentiment double"
MANIFEST = "_manifest"


def standardize(df: DataFrame, sentiment: str = "sentiments") -> DataFrame:
    """Common column names; names that are absent are passed over."""
    return df.withColumnsRenamed({"close": "Close", "volume": "Volume", "sentiment": sentiment})


def write_panel(df: DataFrame, path: str, fmt: str = "parquet", series: Series = SERIES) -> None:
    """One folder per key, rows in date order inside each file and files in date order among each other.

    Tasks get ranges of (key, block of days), so a long series is written by several of them, each
    with later days than the one before. What each file holds is then read back, its dates alone, and
    kept in ``path/_manifest`` (see ``panel_files``). Ranges are drawn from a sample, for which Spark
    runs ``df`` a second time: hand over a written table where that is dear. Of rows with one key and
    date the order isn't told; rows without a date come first.
    """
    blocks = whole_div(day_number(series), series.block_rows)
    (
        df.withColumn(BLOCK, blocks)
        .repartitionByRange(series.key, BLOCK)
        .sortWithinPartitions(series.key, series.date)
        .drop(BLOCK)
        .write.mode("overwrite")
        .option("header", True)
        .partitionBy(series.key)
        .format(fmt)
        .save(path)
    )
    rows = df.sparkSession.read.schema(df.schema).option("header", True).format(fmt).load(path)
    held = rows.select(F.col(f"`{series.key}`").alias("key"), "_metadata.file_path", F.col(f"`{series.date}`").cast("date").alias("day"))
    files = held.groupBy("key", "file_path").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("rows"))
    in_order = Window.partitionBy("key").orderBy(F.col("first").asc_nulls_first(), "last", "file_path")
    before = F.coalesce(F.sum("rows").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files.withColumns({"nth": F.row_number().over(in_order), "before": before}).write.parquet(f"{path}/{MANIFEST}")


def panel_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a written panel (key, file_path, first, last, rows, nth, before), in date order by ``nth``.

    ``first`` and ``last`` are the dates a file holds, ``before`` counts the rows of earlier files of its key.
    """
    return spark.read.parquet(f"{path}/{MANIFEST}")


def read_panel(
    spark: SparkSession, path: str | list[str], fmt: str = "parquet", keys: list[str] | None = None, schema: str = PANEL_SCHEMA
) -> DataFrame:
    """A written panel, or single panel files; ``keys`` prunes the folders that are read."""
    rows = spark.read.schema(schema).option("header", True).format(fmt).load(path)
    return rows if keys is None else rows.where(F.col("Ticker").isin(keys))


def read_panel_dates(
    spark: SparkSession, path: str, since: str | None = None, until: str | None = None, fmt: str = "parquet",
    keys: list[str] | None = None, schema: str = PANEL_SCHEMA,
) -> DataFrame:
    """Rows of a written panel from ``since`` to ``until``, both included: only files that hold such days are listed and opened.

    Rows without a date are left out where a bound is given. No such file gives an empty panel.
    """
    files, inside = panel_files(spark, path), F.lit(True)
    if keys is not None:
        files, inside = files.where(F.col("key").isin(keys)), inside & F.col("Ticker").isin(keys)
    if since is not None:
        files, inside = files.where(F.col("last") >= F.to_date(F.lit(since))), inside & (F.col("Date") >= F.to_date(F.lit(since)))
    if until is not None:
        files, inside = files.where(F.col("first") <= F.to_date(F.lit(until))), inside & (F.col("Date") <= F.to_date(F.lit(until)))
    # Names of files, as the scan would list them on the driver anyway. Folder names are quoted twice in them.
    named = F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))
    found = [row.file for row in files.select(named.alias("file")).collect()]
    if not found:
        return read_panel(spark, path, fmt, schema=schema).where(F.lit(False))
    return spark.read.schema(schema).option("header", True).option("basePath", path).format(fmt).load(found).where(inside)


def numbered_panel(spark: SparkSession, path: str, schema: str = PANEL_SCHEMA) -> DataFrame:
    """A panel written as Parquet with ``nth``, the number of each row in its series by date, from 1.

    The place of a row in its file and the rows of earlier files tell it: nothing is sorted, and only
    the list of files is joined.
    """
    rows = spark.read.schema(schema).parquet(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("_at"))
    numbered = placed.join(panel_files(spark, path).select("file_path", "before"), "file_path")
    return numbered.select(*rows.columns, (F.col("before") + F.col("_at") + 1).alias("nth"))
