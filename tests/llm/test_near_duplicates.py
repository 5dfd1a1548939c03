"""Components against a comparison of all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from against_sql import differences_to_sql
from llm_paths import DATA

from tidemark.llm import near_duplicates as nd
from tidemark.llm.components import components
from tidemark.llm.queries import QUERIES, SQL


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    part = {i: i for i in sets}
    def root(i):
        while part[i] != i:
            i = part[i]
        return i
    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= percent * len(sets[a] | sets[b]):
                part[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_random_near_copies(spark, percent):
    draw = random.Random(percent)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    rows = []
    for base in range(12):
        text = [word() for _ in range(draw.choice([3, 8, 60, 200, 400]))]
        for _ in range(14):
            rows.append((len(rows), " ".join(word() if draw.random() < draw.choice([0, 0.01, 0.03, 0.06]) else w for w in text)))
            if draw.random() < 0.3:
                text = rows[-1][1].split()
    draw.shuffle(rows)
    rows = [(i, t.upper() if i % 7 == 0 else t) for i, (_, t) in enumerate(rows)] + [(900, None), (901, " \n"), (902, "one two"), (903, "ONE\ttwo"), (904, "é é")]
    got = nd.link_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, percent)


def test_query_equals_sql(spark):
    name = "op5_odd_sketch_near_duplicates"
    assert differences_to_sql(QUERIES[name](spark, DATA), SQL[name], DATA) == []


def test_estimates_are_near(spark):
    draw = np.random.default_rng(4)
    for share in (0.75, 0.85, 0.95):
        both, n = [f"w{i}" for i in range(1000)], int(1000 * (1 - share) / (1 + share))
        errors = []
        for _ in range(12):
            own = [draw.integers(0, 2**63, 1000, dtype=np.uint64) for _ in range(2)]
            common = own[0][: 1000 - n]
            sets = [np.concatenate([common, x[1000 - n :]]) for x in own]
            samples = np.stack([[((s ^ f) * m).min() for s in sets] for f, m in zip(nd._FLIP, nd._SPREAD)])
            sketches = nd._odd_sketches(samples)
            true = (1000 - n) / (1000 + n)
            errors.append(nd.estimated_similarity(pa.array([sketches[0]]), pa.array([sketches[1]]))[0].as_py() - true)
        assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < share - nd.least_estimate(int(100 * share))
        assert both


def test_components_of_a_long_chain(spark):
    links = spark.range(200).selectExpr("id * 7 % 201 AS a", "(id + 1) * 7 % 201 AS b")
    assert {(r.node, r.component) for r in components(links).collect()} == {(i, 0) for i in range(201)}
    assert components(links.limit(0)).count() == 0


def test_edges(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (0, "A b\nc d e F"), (None, None), (5, None), (6, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = sorted(map(tuple, nd.link_near_duplicates(docs).collect()), key=repr)
    want = [(None, 2, None, True), (1, 2, 0, False), (1, 2, 0, False), (0, 2, 0, True), (None, 0, None, True), (5, 0, 5, True), (6, 0, 6, True)]
    assert got == sorted(want, key=repr)
    assert sorted(r.doc_id or -1 for r in nd.without_near_duplicates(docs).collect()) == [-1, -1, -1, 5, 6]
    assert nd.link_near_duplicates(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_one_document(spark):
    """A text that shares its id with a copy isn't lost, and rows without id or text stay."""
    a, b = "one two three four five six seven", "quite another text of some more words"
    rows = [(0, a, "x"), (1, a, "y"), (1, b, "z"), (2, a, "w"), (None, a, "n"), (3, None, "e"), (4, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string")
    left = nd.without_near_duplicates(docs)
    assert sorted(r.words for r in left.collect()) == ["e", "f", "n", "x", "y", "z"]
