"""The law of near equal bytes, and slots without gaps."""

import zlib
from collections import defaultdict

import pytest
from llm_paths import DATA
from pyspark.sql import functions as F

from tidemark.llm.queries import QUERIES
from tidemark.llm.sharding import shard_by_bytes


def check(rows, n_shards, slack):
    slots, sizes = defaultdict(list), defaultdict(int)
    for row in rows:
        slots[row.shard].append(row.slot)
        sizes[row.shard] += row.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(n_shards))
    mean = sum(sizes.values()) / n_shards
    assert all(abs(sizes[k] - mean) <= slack for k in range(n_shards))


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op1_histogram_sharding"](spark, DATA).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items()
    }
    assert len(rows) == len(texts)
    check(rows, 16, 2 * max(r.size for r in rows))


@pytest.mark.parametrize("block_bytes", [100, 1 << 20])
def test_repeated_rows_are_spread(spark, block_bytes):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("same text").alias("text"), F.lit("x").alias("Slot"))
    rows = shard_by_bytes(df, 7, block_bytes=block_bytes).collect()
    assert len(rows) == 3000 and {r.doc_id for r in rows} == {None, *(i for i in range(3000) if i % 3)}
    check(rows, 7, 10)


def test_a_text_larger_than_a_shard(spark):
    df = spark.createDataFrame([(1, "x" * 5000), (2, None), (3, ""), (4, "y")], "doc_id long, text string")
    rows = shard_by_bytes(df, 3).collect()
    assert sorted(r.size for r in rows) == [1, 1, 2, 5001]
    check(rows, 3, 5002)
    assert shard_by_bytes(df.limit(0), 3).count() == 0
    assert {r.shard for r in shard_by_bytes(df, 1).collect()} == {0}


def test_rows_move_once_without_python(spark):
    plan = QUERIES["op1_histogram_sharding"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("text#") and sum("text#" in line for line in plan.split("\n") if "Exchange" in line) <= 1
