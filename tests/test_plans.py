"""The shape of physical plans: shuffles, joins, pruning and the absence of Python."""

import re

import pytest
from paths import SMALL
from pyspark.sql import functions as F

from tidemark.operators.blocks import attach_per_key
from tidemark.operators.cumulative import cumreturn, cumsum, ffill
from tidemark.operators.indicators import INDICATORS, PRICE_INDICATORS, add_indicators
from tidemark.operators.sentiment import lexicon_score
from tidemark.plans import market
from tidemark.plans.queries import QUERIES
from tidemark.series import PANEL, SERIES
from tidemark.sources import read_panel


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> int:
    return len(re.findall(r"\bExchange ", plan))


@pytest.fixture(scope="module")
def panel(spark, panel_folder):
    return read_panel(spark, panel_folder, "csv")


def test_one_shuffle_for_all_windowed_indicators(panel):
    names = [n for n in INDICATORS if not INDICATORS[n].running]
    plan = plan_of(add_indicators(panel, names, series=PANEL))
    assert exchanges(plan) == 1
    assert "hashpartitioning(Ticker" in plan and "_block" in plan
    assert "Python" not in plan


def test_running_totals_add_only_the_block_table(panel):
    plan = plan_of(add_indicators(panel, PRICE_INDICATORS, series=PANEL))
    assert "Python" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["densify", "panel", "panel_driven", "tweet_driven", "return_kde", "return_histogram", "horizon", "compare_forecast", "ar_exog_forecast"])
def test_no_cross_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan


def test_no_window_over_a_whole_key(spark):
    """Windows over rows run inside (key, block); only block tables are windowed by key alone, and counts of 16 bits inside medians."""
    plan = plan_of(add_indicators(market.panel(spark, SMALL), series=PANEL, names=PRICE_INDICATORS))
    for line in plan.splitlines():
        if " Window [" not in line and not line.strip().startswith("Window ["):
            continue
        partitioning, ordering = re.findall(r"\[([^\[\]]*)\]", line)[-2:]
        counted = "prefix" in partitioning and "_at" in ordering  # at most 65,536 rows for each wanted rank
        assert "_block" in partitioning or "_block" in ordering or counted, line[-200:]


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(QUERIES["daily_mean"](spark, SMALL))
    assert re.search(r"ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string>", plan)


def test_key_filter_reaches_the_scan_below_windows(panel, spark, tmp_path):
    path = str(tmp_path / "p")
    panel.write.parquet(path)
    rows = add_indicators(read_panel(spark, path), ["RSI"], series=PANEL).where("Ticker = 'BETA'")
    assert "EqualTo(Ticker,BETA)" in plan_of(rows)


@pytest.mark.parametrize("negation", [False, True])
def test_texts_are_read_once_and_scored_where_they_stand(spark, negation):
    texts = market.table(spark, SMALL, "documents").select("doc_id", F.col("text").alias("tweet"))
    plan = plan_of(lexicon_score(texts, negation=negation))
    assert plan.count("regexp_replace") == 1 and plan.count("FileScan") == 1
    assert exchanges(plan) == 0 and "Python" not in plan


def test_large_key_is_joined_in_many_places(spark):
    rows = spark.range(10_000).select(
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("Date"), F.lit("hot").alias("Ticker")
    )
    per_key = spark.range(1).select(F.lit("hot").alias("Ticker"), F.lit(1.0).alias("v"))
    joined = attach_per_key(rows, per_key, SERIES)
    assert joined.where("v = 1").count() == 10_000
    assert "_salt" in plan_of(joined)


@pytest.mark.parametrize("name", ["cumsum", "obv", "ffill", "cumreturn"])
def test_running_values_leave_other_columns_alone(spark, tmp_path, panel, name):
    """An unrelated wide column is in no scan and no exchange."""
    path = str(tmp_path / "rows")
    panel.withColumns({"unrelated": F.repeat("Ticker", 500), "Return": F.lit(0.01)}).write.parquet(path)
    rows = spark.read.parquet(path)
    made = {
        "cumsum": lambda: cumsum(rows, "Volume", "out", PANEL),
        "obv": lambda: add_indicators(rows, ["OBV"], series=PANEL).withColumnRenamed("OBV", "out"),
        "ffill": lambda: ffill(rows, ["Close"], PANEL).withColumnRenamed("Close", "out"),
        "cumreturn": lambda: cumreturn(rows, {"out": "Return"}, PANEL),
    }[name]().select("Date", "Ticker", "out")
    assert made.count() == panel.count()
    assert "unrelated" not in plan_of(made)
