"""Hits against a search of every window in every text, and against SQL."""

import random
import re

import pytest
from against_sql import differences_to_sql
from llm_paths import DATA

from tidemark.llm.decontaminate import find_benchmark
from tidemark.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    words, hit, ids = words_of(text), set(), set()
    for item, content in items:
        own = words_of(content)
        for k in range(max(1, len(own) - 9) if own else 0):
            part = own[k : k + 10]
            for i in range(len(words) - len(part) + 1):
                if words[i : i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids), hit


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_random_texts(spark, block_bytes):
    draw = random.Random(5)
    words = ["Aa", "b1", "é", "Ünd", "x", "ZZ"]
    join = lambda n: "".join(draw.choice(words) + draw.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, join(draw.choice([1, 3, 10, 14]))) for i in range(12)] + [(90, None), (91, " ,. "), (92, "Aa b1 é")]
    texts = [join(draw.randint(0, 60)) for _ in range(60)] + [f"{join(8)}{items[k][1]}{join(8)}" for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(900, None), (901, "")], "doc_id long, text string")
    found = find_benchmark(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    for row in found.collect():
        n_words, n_hit, ids, hit = brute(row.text, items)
        assert (row.n_words, row.n_hit, row.hit_items) == (n_words, n_hit, ids)
        places = [m.span() for m in WORD.finditer((row.text or "").translate(LOWER))]
        assert {k for s in row.hit_spans for k in range(s.first, s.last + 1)} == hit
        assert all((s.start, s.end) == (places[s.first][0], places[s.last][1]) for s in row.hit_spans)


def test_query_equals_sql(spark):
    name = "op6_benchmark_decontamination"
    assert differences_to_sql(QUERIES[name](spark, DATA), SQL[name], DATA) == []


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", 7)], "doc_id long, text string, N_hit int")
    none = spark.createDataFrame([], "item_id long, text string")
    row = find_benchmark(docs, none).collect()[0]
    assert (row.n_words, row.n_hit, row.hit_items, row.hit_spans) == (3, 0, [], [])
    assert find_benchmark(docs.limit(0), none).count() == 0
    same = spark.createDataFrame([(None, "a b"), (2, "A b"), (2, "a B")], "item_id long, text string")
    assert find_benchmark(docs.union(docs), same).collect()[1].hit_items == ["2", "null"]
