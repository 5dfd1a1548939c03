"""Runs against loops over all periods, whole and in small tiles, and the query against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_paths import DATA
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.periodic_runs import find_periodic_runs, runs_of_units


def plain_runs(words):
    """Every (start, length, period), by comparing with every shift."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        start = None
        for i, equal in enumerate(same):
            if equal and start is None:
                start = i
            if not equal and start is not None:
                if i + q - start >= max(6, 4 * q):
                    found.append((start, i + q - start, q))
                start = None
    whole = []
    for start, length, q in found:
        part = words[start : start + length]
        if not any(part[d:] == part[:-d] for d in range(1, q)):
            whole.append((start, length, q))
    return sorted(whole, key=lambda run: (run[0], run[2]))


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_collapsed(words, runs):
    repeated = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(word for i, word in enumerate(words) if i not in repeated)


def drawn_words(rng, size):
    words = []
    while len(words) < size:
        part = [rng.choice("abcd"[: rng.choice([1, 2, 4])]) for _ in range(rng.randint(1, 9))]
        words += part * rng.choice([1, 1, 2, 4, 5, 9])
    return words[: len(words) - rng.randint(0, 3)]


def test_units_equal_loops():
    rng = random.Random(3)
    for _ in range(60):
        units = [drawn_words(rng, rng.randint(0, 90)) for _ in range(rng.randint(1, 5))]
        ids = np.array([ord(word) for unit in units for word in unit], np.int64)
        sizes = np.array([len(unit) for unit in units])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        got = [(i, s, e - s, q) for i, s, e, q in runs_of_units(ids, begins, sizes).tolist()]
        assert got == [(i, *run) for i, unit in enumerate(units) for run in plain_runs(unit)]


def as_rows(found):
    rows = found.select("doc_id", F.transform("runs", lambda r: F.array(r.start, r.length, r.period)).alias("runs"), "collapsed").collect()
    return sorted(((r.doc_id, [tuple(run) for run in r.runs], r.collapsed) for r in rows), key=repr)


@pytest.mark.parametrize("long_bytes", [1 << 16, 40])
def test_texts_equal_loops(spark, long_bytes):
    """In one tile, and with nearly all texts in tiles of 16 words and more."""
    rng = random.Random(4)
    texts = [rng.choice(["", "\t "]).join([" ".join(drawn_words(rng, rng.choice([5, 60, 400])))]) for _ in range(25)]
    texts += ["", None, " \n ", "é " * 300, "a b c d", "x " * 5, "x " * 6, ("one two\x0bthree\r\n" * 9) + "one"]
    rows = [(i % 30, text) for i, text in enumerate(texts)] + [(None, "z " * 70), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = as_rows(find_periodic_runs(docs, long_bytes=long_bytes, tile_words=16))
    want = []
    for number, text in rows:
        runs = plain_runs(plain_words(text))
        want.append((number, runs, plain_collapsed(plain_words(text), runs)))
    assert got == sorted(want, key=repr)


def test_long_run_over_many_tiles(spark):
    """One word a hundred thousand times, and a period longer than a low tile."""
    period = [f"w{i}" for i in range(3000)]
    rows = [(1, "spam " * 100_000), (2, "first " + " ".join(period * 5) + " last")]
    found = find_periodic_runs(spark.createDataFrame(rows, "doc_id int, text string"), tile_words=1024)
    got = {r[0]: (r[1], len(r[2].split())) for r in as_rows(found)}
    assert got == {1: ([(0, 100_000, 1)], 1), 2: ([(1, 15_000, 3000)], 3002)}


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id string, text string, _row int, runs int")
    assert find_periodic_runs(empty).collect() == []
    clash = spark.createDataFrame([("a", "b b b b b b", 1, 2, "x")], "doc_id string, text string, _row int, runs int, collapsed string")
    assert as_rows(find_periodic_runs(clash, long_bytes=3, tile_words=16)) == [("a", [(0, 6, 1)], "b")]


def test_tiles_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        find_periodic_runs(spark.createDataFrame([], "doc_id int, text string"), tile_words=100)


def test_query_equals_plain_version(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for number, text in docs:
        words, h = plain_words(text), zlib.crc32(str(number).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [word if i < a else words[a + (i - a) % p] for i, word in enumerate(words)]
        runs = plain_runs(words)
        best = min(((-length, start, q) for start, length, q in runs), default=None)
        first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        digests = ["".join(f"{s},{length},{q}\n" for s, length, q in runs), plain_collapsed(words, runs)]
        assert got[number] == (len(runs), *first, *[hashlib.sha256(x.encode()).hexdigest() for x in digests]), number
