"""Each stage against plain loops over its own input, and the entry module."""

import importlib.util
import pathlib

import corpus_pipeline
import pytest
from llm_paths import DATA
from test_decontaminate import brute as hits
from test_line_runs import brute_by_words
from test_near_duplicates import brute as near
from test_packing import check
from test_quality import brute as quality

from tidemark.session import written

ROOT = pathlib.Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage, by name."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, DATA), "stage")
        found[name] = (docs, after)
        docs = after
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.orderBy("doc_id").collect()}


def test_columns_and_names(stages):
    assert list(stages) == ["quality rules", "line dedup", "near duplicates", "benchmark decontamination", "packing"]
    assert all(after.schema.simpleString() == before.schema.simpleString() for before, after in list(stages.values())[:-1])


def test_quality_rules(stages):
    before, after = map(texts, stages["quality rules"])
    assert after == {i: t for i, t in before.items() if quality(t)[-1]}


def test_line_dedup(stages):
    before, after = map(texts, stages["line dedup"])
    left = {i: text for i, (text, _, n) in zip(before, brute_by_words(list(before.values()))) if text.strip() or not n}
    assert after == left and len(left) < len(before)
    assert all(r.n_chars == len(r.text) for r in stages["line dedup"][1].collect())


def test_near_duplicates(stages):
    before, after = map(texts, stages["near duplicates"])
    kept = {i for i, (_, _, own) in near(list(before.items()), 80).items() if own}
    assert after == {i: before[i] for i in kept}


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = map(texts, stages["benchmark decontamination"])
    assert after == {i: t for i, t in before.items() if not hits(t, items)[1]}


def test_packing_of_what_is_left(stages):
    before, after = stages["packing"]
    n, total = check(after.collect(), texts(before), 4096)
    assert n <= total / 4096 + 2


def test_entry_registers_all(spark):
    spec = importlib.util.spec_from_file_location("entry_with_llm", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert names["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    assert set(entry.oracle_sql()) <= set(names)
