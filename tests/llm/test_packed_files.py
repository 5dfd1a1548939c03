"""Files read back against the tokenizer: every id once, in place, with right lengths and positions."""

import zlib
from collections import defaultdict

import numpy as np
from llm_paths import DATA
from test_packing import ids_of

from tidemark.llm.packed_files import packed_sequences, read_packed, write_packed
from tidemark.llm.queries import QUERIES, tokenizer_path
from tidemark.session import new_table_path


def unpacked(rows, window, pad=0):
    docs = defaultdict(list)
    for row in rows:
        ids, positions = np.frombuffer(row.ids, "<u4"), np.frombuffer(row.positions, "<u4")
        assert len(ids) == len(positions) == window and row.cu_seqlens[0] == 0
        used = row.cu_seqlens[-1]
        assert (ids[used:] == pad).all() and (positions[used:] == 0).all()
        for doc, start, a, b in zip(row.segment_docs, row.segment_starts, row.cu_seqlens, row.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            docs[doc].append((start, ids[a:b].tolist()))
    assert len({row.sequence_id for row in rows}) == len(rows)
    return docs


def test_round_trip(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    path = new_table_path(spark, "packed")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    write_packed(docs, path, tokenizer_path(), 2, window=256, pad_id=9)
    rows = read_packed(spark, path).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(ids_of(t)) for t in texts.values())
    back = unpacked(rows, 256, 9)
    assert {k: sum((p for _, p in sorted(v)), []) for k, v in back.items()} == {k: ids_of(t) for k, t in texts.items()}
    assert all(start % 256 == 0 for parts in back.values() for start, _ in parts)


def test_query(spark):
    rows = {r.sequence_id: r for r in QUERIES["op10_packed_token_files"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    same = packed_sequences(docs, tokenizer_path(), 2).collect()
    assert len(rows) == len(same) and sum(r.n_segments for r in rows.values()) == sum(len(s.segment_docs) for s in same)
    for s in same:
        row = rows[s.sequence_id]
        assert (row.ids_crc32, row.positions_crc32) == (zlib.crc32(s.ids), zlib.crc32(s.positions))
        assert row.segment_docs == ",".join(map(str, s.segment_docs)) and row.n_tokens == s.cu_seqlens[-1]


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b c"), (4, "long text " * 99), (4, "long text " * 99)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    for group_tokens in (30, 1 << 20):
        back = unpacked(packed_sequences(df, tokenizer_path(), 2, window=16, group_tokens=group_tokens).collect(), 16)
        assert set(back) == {1, 2, None, 4} and back[1] == back[2] == [(0, [2])]
        assert sum(len(p) for _, p in back[4]) == 2 * len(ids_of(rows[3][1]))
    assert packed_sequences(df.limit(0), tokenizer_path(), 2).count() == 0
