"""Best-fit-decreasing packing of documents into windows of tokens.

A document longer than a window is first cut into full windows, which are sequences by themselves,
and a rest. Rests are packed longest first, each into the open window with the least room that still
takes it. A segment tree over the capacities 0 to ``window`` finds that window in a walk from the
root: a node says whether any window below it is open, so the tightest is the first open leaf at or
above the length.

Rests are packed group by group. Groups are drawn by hash, so each has its fair share of every
length; a group leaves about one window part empty. What a group holds is bounded by
``group_tokens``, however many documents there are, and a text shared by many is no hot key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import release_memory, text_slices, without
from tidemark.llm.tokens import SLICE_BYTES, worker_encoder

#: Tokens of a group at most, on average: a bound on what one task packs at once.
GROUP_TOKENS = 1 << 22
#: UTF-8 bytes that make a token at least, on average, in any text: for the number of groups.
LEAST_BYTES_A_TOKEN = 1

PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class TightestFit:
    """Segment tree over capacities: the open window with the least room of at least so many tokens."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = bytearray(2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = self.leaves + room
        while node and not self.open[node]:
            self.open[node] = 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of the tightest fit."""
        node = self.leaves + length
        while not self.open[node]:
            while node & 1:  # a right child: what is to its right hangs below an ancestor
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        room = node - self.leaves
        window = self.windows[room].pop()
        if not self.windows[room]:
            self.open[node] = 0
            while node > 1 and not (self.open[node] or self.open[node ^ 1]):
                node >>= 1
                self.open[node] = 0
        return room, window


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each length; no length is over ``window``. Ties go by position."""
    tree, n_windows = TightestFit(window), 0
    windows, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = tree.take(length)
        if found is None:
            found, n_windows = (window, n_windows), n_windows + 1
        room, windows[i] = found
        offsets[i] = window - room
        if room > length:
            tree.add(room - length, int(windows[i]))
    return windows, offsets


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096, id: str = "doc_id", text: str = "text", with_ids: bool = False, id_bytes: int = 4
) -> DataFrame:
    """(id, ``PIECE``): each document's ids and an end id, cut into full windows and a rest.

    With ``with_ids`` the rows also have the ids, as little-endian unsigned numbers of ``id_bytes`` bytes.
    """
    schema = f"`{id}` {docs.schema[id].dataType.simpleString()}, {PIECE}" + (", ids binary" * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(1), SLICE_BYTES):
                yield _pieces(batch.column(0).slice(done, len(part)), id, *encoder.encode(part), end_id, window, with_ids * id_bytes)
                done += len(part)
            release_memory()

    return docs.select(F.col(id), F.col(text)).mapInArrow(cut, schema)


def _pieces(ids_of_docs: pa.Array, id: str, ids: np.ndarray, begins: np.ndarray, end_id: int, window: int, id_bytes: int) -> pa.RecordBatch:
    place, start, length, crc, tokens, raw = [], [], [], [], [], []
    ending = np.array([end_id], "<u4").tobytes()
    packed = ids.astype("<u4", copy=False).tobytes()
    for doc, (begin, end) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
        own = packed[4 * begin : 4 * end] + ending
        n = len(own) // 4
        for at in range(0, n, window):
            piece = own[4 * at : 4 * (at + window)]
            place.append(doc)
            start.append(at)
            length.append(len(piece) // 4)
            crc.append(zlib.crc32(piece))
            tokens.append(n)
            if id_bytes:
                raw.append(np.frombuffer(piece, "<u4").astype(f"<u{id_bytes}").tobytes())
    columns = [ids_of_docs.take(pa.array(place, pa.int32()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, tokens)]
    names = [id, "start", "length", "ids_crc32", "doc_tokens"]
    if id_bytes:
        columns, names = [*columns, pa.array(raw, pa.binary())], [*names, "ids"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def group_count(docs: DataFrame, text: str = "text", group_tokens: int = GROUP_TOKENS) -> int:
    """Groups such that none is likely to hold more than ``group_tokens``: a text has fewer tokens than bytes, end id aside."""
    bytes_ = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1)).first()[0] or 0
    return max(1, -(-bytes_ // (LEAST_BYTES_A_TOKEN * group_tokens)))


def with_group(pieces: DataFrame, n_groups: int, id: str = "doc_id") -> DataFrame:
    """Add ``_group``: by hash of identifier, start and place in the input, so that repeated rows spread too."""
    drawn = F.xxhash64(F.col(id), F.col("start"), F.col("ids_crc32"), F.monotonically_increasing_id())
    return pieces.withColumn("_group", F.pmod(drawn, F.lit(n_groups)).cast("int"))


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    window: int = 4096,
    id: str = "doc_id",
    text: str = "text",
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """Rows (id, ``PIECE``, sequence_id, offset): where each piece of each document lies.

    ``sequence_id`` is unique; pieces of a sequence fill it from offset 0 without gaps, and
    its end is padding. Only lengths and places are shuffled, not token ids.

    Edge cases: a NULL or empty text is the end id alone. A document of exactly a window is one
    piece; longer ones are cut, however long, and lose nothing. Repeated rows and equal or NULL
    identifiers are packed row by row. Equal lengths keep the order of identifier and start. An
    empty table has no sequences. Other columns are ignored.
    """
    docs = without(docs.select(id, text), "_group")
    pieces = with_group(token_pieces(docs, tokenizer, end_id, window, id, text), group_count(docs, text, group_tokens), id)
    schema = f"{pieces.drop('_group').schema.simpleString()[7:-1]},sequence_id:bigint,offset:bigint"

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([id, "start", "ids_crc32"], kind="stable")
        windows, offsets = best_fit_decreasing(rows["length"].to_numpy(), window)
        return rows.drop(columns="_group").assign(sequence_id=sequence_ids(int(key[0]), windows), offset=offsets)

    return pieces.groupBy("_group").applyInPandas(pack, schema)


def sequence_ids(group: int, windows: np.ndarray) -> np.ndarray:
    """Group in the upper 32 bits, window in the lower."""
    return (group << 32) + windows
