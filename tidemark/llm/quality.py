"""Quality rules: compression bands over whole texts and fixed chunks, beside plain counts.

A text that compresses far better than prose of its length repeats itself; one that hardly
compresses is noise, keys or encoded data. How well prose compresses depends on its length, so each
length has its own band of ratios. Chunks of a fixed size find the same in parts of a long text.

Every text is judged alone: there is no shuffle, and a task holds one slice of a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import plain_bytes, release_memory, text_slices, without

#: Text judged at once: counting windows takes some 40 bytes a word.
SLICE_BYTES = 1 << 20
SYMBOLS = b"#*$%&|<>"
WINDOW = 5

RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, zstd_ratio double, n_chunks bigint, n_bad_chunks bigint, kept boolean"
)


@dataclass(frozen=True)
class CompressionBands:
    """Limits on compressed size over size.

    ``whole`` has (bytes below which the band holds, least ratio, greatest ratio), by length.
    ``chunk_bytes`` long chunks have one band, as they have one length; what is left at the end of a
    text is judged with the chunk before it. A text fails if more than ``bad_share`` of its chunks do.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (128, 0.00, 9.00),  # too short to tell
        (256, 0.42, 1.10),
        (512, 0.36, 0.95),
        (1024, 0.32, 0.85),
        (2048, 0.28, 0.78),
        (4096, 0.26, 0.75),
        (8192, 0.24, 0.72),
        (float("inf"), 0.22, 0.70),
    )
    chunk_bytes: int = 2048
    chunk_least: float = 0.26
    chunk_greatest: float = 0.78
    bad_share: float = 0.25
    level: int = 3


def score_quality(
    df: DataFrame,
    text: str = "text",
    bands: CompressionBands = CompressionBands(),
    least_words: int = 10,
    repeat_percent: int = 20,
) -> DataFrame:
    """Add the counts and the verdict of ``RESULT`` to each row.

    ``base_failed``: fewer than ``least_words`` words, or more than ``repeat_percent`` percent of
    them inside a window of five words that the text has twice. ``kept`` is false for those and for
    texts outside the compression bands.

    Edge cases: a NULL text counts as one without words, so it fails; so does an empty text. A very
    long text is one slice by itself and is compressed chunk by chunk. Repeated rows get equal
    verdicts. An empty table stays empty. Input columns named as one of the added ones are replaced;
    all others pass through untouched.
    """

    @F.arrow_udf(RESULT_TYPE)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        whole = zstandard.ZstdCompressor(level=bands.level)
        for texts in batches:
            parts = [_score(part, bands, whole, least_words, repeat_percent) for part in text_slices(texts, SLICE_BYTES)]
            yield pa.concat_arrays(parts) if parts else pa.array([], RESULT_ARROW)
        release_memory()

    kept = without(df, "_quality", *RESULT_NAMES)
    return kept.withColumn("_quality", scored(F.col(text))).select(*[F.col(f"`{c}`") for c in kept.columns], "_quality.*")


def _score(texts: pa.Array, bands: CompressionBands, compressor, least_words: int, repeat_percent: int) -> pa.Array:
    raw = plain_bytes(texts)
    n_words, n_repeat = _repeated_words(texts)
    chars = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    blanks = np.array([len(b) - len(b.translate(None, b" \t\n\x0b\x0c\r")) for b in raw], np.int64)
    symbols = np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in raw], np.int64)
    copies = np.array([_repeated_lines(b) for b in raw], np.int64)
    ratio, chunks, bad = _ratios(raw, bands, compressor)
    failed = (n_words < least_words) | (100 * n_repeat > repeat_percent * n_words)
    sizes = np.array([len(b) for b in raw], np.int64)
    limits = np.array(bands.whole)
    band = np.minimum(np.searchsorted(limits[:, 0], sizes, side="right"), len(limits) - 1)
    inside = (ratio >= limits[band, 1]) & (ratio <= limits[band, 2]) & (bad <= bands.bad_share * chunks)
    columns = [n_words, chars - blanks, symbols, copies, n_repeat, failed, ratio, chunks, bad, ~failed & inside]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=RESULT_NAMES)


def _ratios(raw: list[bytes], bands: CompressionBands, compressor) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratio of each whole text, its number of chunks, and how many of those are outside the band.

    A text shorter than two chunks has no chunks: its whole ratio says it all.
    """
    ratio, chunks, bad = np.ones(len(raw)), np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
    size = bands.chunk_bytes
    for i, text in enumerate(raw):
        if not text:
            continue
        ratio[i] = len(compressor.compress(text)) / len(text)
        if len(text) >= 2 * size:
            view, n = memoryview(text), len(text) // size
            for k in range(n):
                chunk = view[k * size : (k + 1) * size if k < n - 1 else len(text)]
                bad[i] += not bands.chunk_least <= len(compressor.compress(chunk)) / len(chunk) <= bands.chunk_greatest
            chunks[i] = n
    return ratio, chunks, bad


def _repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if not line.isspace() and line]
    return len(lines) - len(set(lines))


def _pair_names(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    if not len(left):
        return left
    return np.unique(left * (int(right.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)


def _repeated_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many of them are in a window of five that the text has twice.

    Words become numbers, and windows of two, four and five words are named by pairs of names, so
    that equal names mean equal words.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    pieces = split.flatten()
    text_of = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    full = pc.not_equal(pieces, "").to_numpy(zero_copy_only=False)
    text_of = text_of[full]
    n_words = np.bincount(text_of, minlength=len(texts)).astype(np.int64)
    words = pieces.dictionary_encode().indices.to_numpy().astype(np.int64)[full]
    n = len(words) - WINDOW + 1
    if n < 1:
        return n_words, np.zeros(len(texts), np.int64)
    two = _pair_names(words[:-1], words[1:])
    four = _pair_names(two[:-2], two[2:])
    five = _pair_names(four[:n], words[WINDOW - 1 :])
    starts = np.flatnonzero(text_of[:n] == text_of[WINDOW - 1 :])
    _, name, count = np.unique(five[starts] * len(texts) + text_of[starts], return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    found = starts[count[name] > 1]
    edge[found] += 1
    edge[found + WINDOW] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return n_words, np.bincount(text_of[covered], minlength=len(texts)).astype(np.int64)


RESULT_NAMES = [part.split()[0] for part in RESULT.split(", ")]
RESULT_ARROW = pa.struct(
    [(n, {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[k]) for n, k in map(str.split, RESULT.split(", "))]
)
RESULT_TYPE = "struct<" + ", ".join(part.replace(" ", ": ") for part in RESULT.split(", ")) + ">"
