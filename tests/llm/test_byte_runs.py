"""Removed bytes against a dictionary of all strings."""

import hashlib
import random

import numpy as np
import pytest
from llm_paths import DATA

from tidemark.llm import byte_runs
from tidemark.llm.byte_runs import remove_repeated_bytes
from tidemark.llm.queries import QUERIES


def brute(rows, length):
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        if i is not None:
            for p in range(len(raw) - length + 1):
                part = raw[p : p + length]
                first[part] = min(first.get(part, i), i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        if i is not None:
            for p in range(len(raw) - length + 1):
                if first[raw[p : p + length]] < i:
                    gone[p : p + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df, length):
    rows = remove_repeated_bytes(df, length=length).collect()
    return sorted(((r.id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows), key=repr)


@pytest.mark.parametrize("length, seed, small", [(50, 1, True), (50, 2, False), (32, 3, True), (41, 4, True)])
def test_random_texts(spark, monkeypatch, length, seed, small):
    if small:  # many chunks, buckets, slabs and blocks
        for name, value in (("CHUNK_BYTES", 3000), ("BUCKET_BYTES", 2000), ("SLAB", 700), ("BLOCK", 50)):
            monkeypatch.setattr(byte_runs, name, value)
    draw = random.Random(seed)
    piece = lambda n: "".join(draw.choices("abé \n", k=n))
    shared = [piece(draw.randint(10, 150)) for _ in range(12)]
    texts = ["".join(draw.choice([draw.choice(shared), piece(draw.randint(1, 60))]) for _ in range(draw.randint(0, 9))) for _ in range(70)]
    texts += ["a" * 900, "a" * 400 + "b", "ab" * 300, texts[3], texts[3], shared[0] * 9, None, "", "\x00" * 200, "\x00" * 120 + "x"]
    ids = draw.sample(range(-50, 200), len(texts))
    rows = list(zip(ids, texts)) + [(None, texts[3]), (ids[0], texts[5]), (ids[0], texts[5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    assert result(df, length) == brute(rows, length)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = QUERIES["op2_suffix_array_repeats"](spark, DATA).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 50)
    assert sum(r.n_removed for r in got) > 0


def test_empty_table(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_two_residues_meet():
    for i in range(byte_runs.COVER):
        for j in range(byte_runs.COVER):
            d = byte_runs._SHIFT[i, j]
            assert {(i + d) % byte_runs.COVER, (j + d) % byte_runs.COVER} <= set(byte_runs.COVER_SAMPLE)
