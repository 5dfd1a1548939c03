"""Readers and writers."""

import datetime as dt
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.series import PANEL, Series
from tidemark.operators.calendar import densify, horizon, with_warmup
from tidemark.operators.indicators import add_indicators
from tidemark.sources import (
    missing_keys, numbered_panel, panel_files, read_panel, read_panel_dates, read_prices, read_tweets, standardize, union_prices, write_panel,
)


def test_all_price_files_in_one_scan(spark, price_folder, price_files):
    rows = read_prices(spark, price_folder)
    assert rows.dtypes == [("Date", "date"), ("Ticker", "string"), ("Close", "double"), ("Volume", "bigint")]
    got = {r.Ticker: (r.n, r.v) for r in rows.groupBy("Ticker").agg(F.count("*").alias("n"), F.max("Volume").alias("v")).collect()}
    assert got == {key: (len(frame), frame.Volume.max()) for key, frame in price_files.items()}


def test_missing_files_are_passed_over(spark, price_folder, price_files):
    rows = read_prices(spark, price_folder, ["ALFA", "NONE", "LATE", "^IDX"])
    counts = {r.Ticker: r["count"] for r in rows.groupBy("Ticker").count().collect()}
    assert counts == {key: len(price_files[key]) for key in ("ALFA", "LATE", "^IDX")}
    with pytest.raises(ValueError):
        read_prices(spark, price_folder, ["NONE", "alfa"])
    with pytest.raises(ValueError):
        read_prices(spark, "/nowhere/at/all")


def test_many_keys_and_odd_names(spark, price_folder, price_files, tmp_path):
    """Fifty thousand keys are a table that the file list is joined with; missing ones are told; names are no patterns."""
    keys = [f"none-{i}" for i in range(50_000)] + ["BETA", "^IDX"]
    start = time.perf_counter()
    rows = read_prices(spark, price_folder, spark.createDataFrame([(k,) for k in keys], "key string"))
    assert time.perf_counter() - start < 20
    assert {r.Ticker for r in rows.select("Ticker").distinct().collect()} == {"BETA", "^IDX"}
    assert sorted(r.key for r in missing_keys(spark, price_folder, ["ALFA", "NONE", "alfa"]).collect()) == ["NONE", "alfa"]
    for name in ("A[b]", "Ab", "A{b,c}", "A*"):
        price_files["ALFA"].head(2).to_csv(tmp_path / f"{name}.csv", index=False)
    assert {r.Ticker for r in read_prices(spark, str(tmp_path), ["A[b]", "A{b,c}", "A*"]).collect()} == {"A[b]", "A{b,c}", "A*"}


def test_all_price_columns(spark, price_folder):
    rows = read_prices(spark, price_folder, ["ALFA"], all_columns=True)
    assert {"Open", "High", "Low", "Adj Close", "Ticker"} <= set(rows.columns)
    assert rows.where("High < Low").count() == 0


def test_late_key_and_union(spark, price_folder):
    parts = [read_prices(spark, price_folder, [k]) for k in ("ALFA", "LATE")]
    parts[1] = parts[1].withColumn("Volume", (F.col("Volume") % 1000).cast("int"))
    rows = union_prices(parts)
    assert dict(rows.dtypes)["Volume"] == "bigint"
    dense = densify(rows)
    assert dense.count() == 2 * 367
    assert dense.where("Ticker = 'LATE' and Close is null").count() == (dt.date(2020, 12, 10) - dt.date(2019, 12, 31)).days
    with pytest.raises(ValueError):
        union_prices([])


def test_tweets(spark, tmp_path):
    path = tmp_path / "tweets.csv"
    path.write_text(
        'id,date,stock_name,tweet\n1,31/12/2020,AAPL,"so ""good"", really"\n2,1/1/2021,aapl,x\n3,2/1/2021,,y\n4,oops,BA,z\n'
    )
    rows = read_tweets(spark, str(path)).collect()
    assert [r.Date for r in rows] == [dt.date(2020, 12, 31), dt.date(2021, 1, 1), dt.date(2021, 1, 2), None]
    assert rows[0].tweet == 'so "good", really'
    assert [r.Ticker for r in read_tweets(spark, str(path), ["AAPL", "BA"]).collect()] == ["AAPL", "BA"]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_panel_round_trip(spark, tmp_path, fmt, panel_folder):
    path = str(tmp_path / fmt)
    rows = read_panel(spark, panel_folder, "csv")
    write_panel(rows, path, fmt)
    write_panel(rows, path, fmt)
    again = read_panel(spark, path, fmt)
    assert sorted(map(tuple, again.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    one = read_panel(spark, path, fmt, keys=["BETA"])
    assert one.count() == 367
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*\(Ticker#\d+ = BETA\)", plan)


def test_names_are_standardised(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "close double, volume double, sentiment double")
    assert standardize(df).columns == ["Close", "Volume", "sentiments"]
    assert standardize(df.select("volume")).columns == ["Volume"]


def test_warmup_and_horizon(spark, panel_folder):
    panel = read_panel(spark, panel_folder, "csv")
    recent = add_indicators(with_warmup(panel, "2020-12-01", 19), ["SMA_20"], series=PANEL).where("Date >= '2020-12-01'")
    whole = add_indicators(panel, ["SMA_20"], series=PANEL).where("Date >= '2020-12-01'")
    assert recent.count() == 3 * 31
    assert recent.exceptAll(whole).count() == 0
    days = horizon(panel, 7).where("Ticker = 'BETA'").orderBy("step").collect()
    assert [d.Date for d in days] == [dt.date(2021, 1, i) for i in range(1, 8)]


def test_rows_of_a_file_are_in_date_order(spark, tmp_path, panel_folder):
    path = tmp_path / "ordered"
    write_panel(read_panel(spark, panel_folder, "csv").orderBy("Close"), str(path), "csv")
    files = list(path.glob("Ticker=*/*.csv"))
    assert len(files) >= 3
    for file in files:
        days = [line.split(",")[0] for line in file.read_text().splitlines()[1:]]
        assert days == sorted(days) and len(days) > 1


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_files_of_a_key_have_an_order(spark, tmp_path, panel_folder, fmt):
    """Ranges of files don't overlap, and a range of dates opens those alone that hold some; odd keys and dates too."""
    path = str(tmp_path / "panel with space")
    rows = read_panel(spark, panel_folder, "csv").repartition(7)
    odd = [(dt.date(2020, 3, 1), k, 1.0, 2.0, 0.0) for k in ("A/B", "50% + x", "^[1]")] + [(None, "BETA", 5.0, 6.0, 0.0)]
    rows = rows.union(spark.createDataFrame(odd, rows.schema))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_panel(rows, path, fmt, Series(block_rows=16))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = panel_files(spark, path).orderBy("key", "nth").collect()
    assert sum(f.rows for f in files) == rows.count() and max(f.nth for f in files) > 1
    for left, right in zip(files, files[1:]):
        if left.key == right.key:
            assert right.before == left.before + left.rows and (left.last is None or left.last < right.first)
    some = read_panel_dates(spark, path, "2020-02-20", "2020-03-05", fmt)
    assert sorted(some.collect()) == sorted(rows.where("Date between '2020-02-20' and '2020-03-05'").select(*some.columns).collect())
    assert 0 < len(some.inputFiles()) < len(files)
    assert read_panel_dates(spark, path, fmt=fmt).count() == rows.count()
    assert {r.Ticker for r in read_panel_dates(spark, path, fmt=fmt, keys=["A/B", "50% + x", "none"]).collect()} == {"A/B", "50% + x"}
    none = read_panel_dates(spark, path, until="1999-01-01", fmt=fmt)
    assert none.count() == 0 and none.columns == some.columns
    if fmt == "parquet":
        numbered = numbered_panel(spark, path)
        assert "Window" not in numbered._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.Ticker, r.nth, r.Date or dt.date.min) for r in numbered.collect())
        assert got == [(k, n, d) for k, n, d in got if n >= 1] and len({(k, n) for k, n, _ in got}) == rows.count()
        assert all(a[2] < b[2] for a, b in zip(got, got[1:]) if a[0] == b[0])


def test_an_empty_panel_is_written_and_read(spark, tmp_path, panel_folder):
    path = str(tmp_path / "empty")
    write_panel(read_panel(spark, panel_folder, "csv").limit(0), path)
    assert panel_files(spark, path).count() == read_panel_dates(spark, path, "2020-01-01").count() == numbered_panel(spark, path).count() == 0
