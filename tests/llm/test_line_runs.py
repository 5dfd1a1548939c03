"""Deleted lines against a comparison of all runs."""

import hashlib
import random

import pytest
from llm_paths import DATA

from tidemark.llm.line_runs import remove_repeated_lines
from tidemark.llm.queries import QUERIES


def brute(texts, least):
    """Texts in order of their documents; lines of runs of enough words that start earlier too are gone."""
    docs = [t.split("\n") if t is not None else [] for t in texts]
    words = [[len(line.split()) for line in d] for d in docs]
    runs, gone = {}, [set() for _ in docs]
    for d, lines in enumerate(docs):
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if sum(words[d][a:b]) >= least:
                    first = runs.setdefault(tuple(lines[a:b]), (d, a))
                    if first < (d, a):
                        gone[d] |= set(range(a, b))
    return [("\n".join(x for i, x in enumerate(d) if i not in g) if t is not None else None, len(d), len(g)) for t, d, g in zip(texts, docs, gone)]


@pytest.mark.parametrize("least, seed", [(1, 1), (4, 2), (9, 3)])
def test_random_texts(spark, least, seed):
    draw = random.Random(seed)
    lines = ["", "a", "b b", "c c c", "d d d d"]
    texts = ["\n".join(draw.choices(lines, k=draw.randint(0, 14))) for _ in range(24)] + [None, ""]
    texts += [texts[3] + "\n" + texts[5], texts[4]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, N_lines string")
    rows = remove_repeated_lines(df, least_words=least).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_removed) for r in rows] == brute(texts, least)


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    want = {d.doc_id: w for d, w in zip(docs, brute_by_words([d.text for d in docs]))}
    rows = QUERIES["op9_line_runs"](spark, DATA).collect()
    assert len(rows) == len(docs) and sum(r.n_removed for r in rows) > 0
    for row in rows:
        text, n_lines, n_removed = want[row.doc_id]
        assert (row.n_lines, row.n_removed, row.kept_sha256) == (n_lines, n_removed, hashlib.sha256(text.encode()).hexdigest())


def brute_by_words(texts, least=50):
    """As ``brute``, with runs of up to 60 lines only, for long texts: no shortest run is longer here."""
    docs = [t.split("\n") for t in texts]
    first, gone = {}, [set() for _ in docs]
    for d, lines in enumerate(docs):
        for a in range(len(lines)):
            total = 0
            for b in range(a + 1, min(len(lines), a + 60) + 1):
                total += len(lines[b - 1].split())
                if total >= least and first.setdefault(tuple(lines[a:b]), (d, a)) < (d, a):
                    gone[d] |= set(range(a, b))
    return [("\n".join(x for i, x in enumerate(d) if i not in g), len(d), len(g)) for d, g in zip(docs, gone)]


def test_repeated_rows_and_null_identifiers(spark):
    text = "one two three\nfour five\nsix"
    rows = [(None, text), (1, text), (1, text), (1, "six\nfour five"), (2, "x\n" + text), (3, None)]
    got = remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), least_words=6).collect()
    assert sorted(((r.doc_id or 0, r.text, r.n_removed) for r in got), key=repr) == sorted(
        [(0, text, 0), (1, "", 3), (1, "", 3), (1, "six\nfour five", 0), (2, "x", 3), (3, None, 0)], key=repr
    )
    assert remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0
