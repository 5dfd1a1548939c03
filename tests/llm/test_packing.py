"""Pieces against the tokenizer itself, and windows against a search of all open ones."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_paths import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import tokens
from tidemark.llm.packing import best_fit_decreasing, pack_documents
from tidemark.llm.queries import QUERIES, tokenizer_path
from tidemark.llm.tokens import WordEncoder

TOKENIZER = Tokenizer.from_file(tokenizer_path())


def brute(lengths, window):
    rooms, sums = [], []
    for length in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits)[1]] -= length
        else:
            rooms.append(window - length)
    return sorted(rooms)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=60))
def test_tightest_window_is_found(lengths):
    windows, offsets = best_fit_decreasing(np.array(lengths, np.int64), 37)
    held = defaultdict(list)
    for w, o, n in zip(windows, offsets, lengths):
        held[int(w)].append((int(o), n))
    for pieces in held.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
    assert sorted(37 - sum(n for _, n in p) for p in held.values()) == brute(lengths, 37)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, texts, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        by_doc[row.doc_id].append(row)
        by_sequence[row.sequence_id].append((row.offset, row.length))
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids, at = ids_of(texts[doc]), 0
        for row in sorted(pieces, key=lambda r: r.start):
            part = ids[row.start : row.start + row.length]
            assert row.start == at and len(part) == row.length and row.doc_tokens == len(ids)
            assert row.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += row.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return len(by_sequence), sum(r.length for r in rows)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    n, total = check(QUERIES["op7_best_fit_packing"](spark, DATA).collect(), texts, 4096)
    assert n <= total / 4096 + 2


@pytest.mark.parametrize("group_tokens", [50, 1 << 20])
def test_edges(spark, group_tokens):
    texts = {1: None, 2: "", 3: "word " * 7, 4: "word " * 8, 5: "a long text, " * 999, 6: " \n", 7: "x <|endoftext|> y"}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, Length int")
    check(pack_documents(df, tokenizer_path(), 2, window=8, group_tokens=group_tokens).collect(), texts, 8)
    twice = df.union(df).where("doc_id = 4")
    rows = pack_documents(twice, tokenizer_path(), 2, window=8).collect()
    assert sorted((r.start, r.length) for r in rows) == [(0, 8), (0, 8), (8, 1), (8, 1)]
    assert pack_documents(df.limit(0), tokenizer_path(), 2).count() == 0


@pytest.mark.parametrize("room", [12, 1_000_000])
def test_word_by_word_equals_whole_texts(monkeypatch, room):
    monkeypatch.setattr(tokens, "TABLE_WORDS", room)
    draw = random.Random(1)
    odd = ["Don't", "DON'T's", "'s", "é", "É,", "é", "H̱a", "İx", "ſ", "ǅ", "ß!", "<|endoftext|>", "<|ENDOFTEXT|>x", "12a", "a|b|", "..,", "한국", "한", "x y", "\x85", "\x1c", "Ω", "🙂a", "a​b", "THE", "the.", "ŉ", "aͅ"]
    texts = ["".join(draw.choice(odd) + draw.choice(["", " ", "\n", "\t ", "  "]) for _ in range(draw.randint(0, 30))) for _ in range(400)]
    encoder = WordEncoder(tokenizer_path())
    for _ in range(2):
        ids, begins = encoder.encode(pa.array([*texts, None]))
        got = [ids[a:b].tolist() for a, b in zip(begins, begins[1:])]
        assert got == [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)] + [[]]
