"""Helpers for Arrow batches inside tasks, and for columns of operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that an operator works on at once in a task; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Cut an array of texts into runs of about ``limit`` bytes, so that working memory is bounded."""
    ends = np.cumsum(byte_lengths(texts))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def plain_bytes(texts: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; NULL is empty."""
    return pc.fill_null(texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary()), b"").to_pylist()


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the start of each (with the end of the last)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(byte_lengths(texts), out=starts[1:])
    return np.frombuffer(b"".join(plain_bytes(texts)), np.uint8), starts


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers 8 MB at a time. By default a batch may take 64 MB, on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker goes on to other tasks, beside an executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add under these names (case ignored)."""
    taken = {name.lower() for name in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


class Words:
    """The words of an array of texts: what lies between blanks and cuts.

    ``table`` maps each byte to itself, to a blank (32) or to a cut (10). ``words`` is an array of
    binary values, ``starts`` has the first word of each text (with the end of the last), and ``cut`` tells of each word
    whether a cut or the beginning of its text lies before it.
    """

    def __init__(self, texts: pa.Array, table: bytes):
        raw = plain_bytes(texts)
        data = np.frombuffer(b"\n".join([*raw, b""]).translate(table), np.uint8)
        solid = (data != 32) & (data != 10)
        edges = np.diff(solid.view(np.int8), prepend=0)  # every text ends with a cut
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        offsets = np.zeros(len(begins) + 1, np.int32)
        np.cumsum(ends - begins, out=offsets[1:])
        self.words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
        texts_at = np.cumsum([0, *(len(x) + 1 for x in raw)])
        self.starts = np.searchsorted(begins, texts_at)
        cuts = np.cumsum(data == 10, dtype=np.int32)[begins]
        self.cut = np.diff(cuts, prepend=-1) > 0

    def ids(self) -> np.ndarray:
        """A number for each word, equal for equal words of this array."""
        return self.words.dictionary_encode().indices.to_numpy()


def byte_table(blanks: bytes, cuts: bytes = b"", lower: bool = False) -> bytes:
    """The table of ``Words``; ``lower`` also maps A-Z to a-z."""
    table = bytearray(range(256))
    if lower:
        table[65:91] = bytes(range(97, 123))
    for byte in blanks:
        table[byte] = 32
    for byte in cuts:
        table[byte] = 10
    return bytes(table)


def stretches(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of the stretches of so many from each beginning, one behind the other."""
    stops = np.cumsum(sizes, dtype=begins.dtype)
    at = np.repeat(begins - (stops - sizes), sizes)
    at += np.arange(len(at), dtype=at.dtype)
    return at
