"""Runs of words that repeat with a period, and texts with the repetitions taken out.

A run is a stretch of words with smallest period q, at least ``LEAST`` words and ``EXPONENT`` periods long,
that no neighbouring word extends. Periods are sought by octave, from B to 2B - 1 with B a power of two, at
boundaries B words apart. The common prefix of the words from a boundary and of those q words further on is the
Z-value of q there. A run reaches over so many periods that at its first boundary the Z-value of q is 2B or more, and by
the theorem of Fine and Wilf q is then the smallest shift under 2B with such a Z-value, or else no smallest period at all. So
each boundary has at most one period of the octave. Shifts are told by the names of 2B words (names double with the
octave), and the Z-values forwards and backwards are then read off the words themselves, which ends the run exactly.

A text of up to ``LONG_BYTES`` is one tile in every octave and solved where it is read. A longer one is exploded into tiles
that overlap by 8B words: the low octaves share tiles of ``TILE_WORDS`` words plus overlap, a higher one has tiles of its own with
twice the words of the octave before. Tiles go to any executor, are solved independently, and give fragments of
runs; fragments are shuffled by (document, period) and stitched where they overlap by a period. A run that a
tile sees less than four periods of lies wholly inside the tile before or after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.arrays import Words, byte_table, release_memory, stretches, text_slices, without
from tidemark.session import written

LEAST = 6
EXPONENT = 4
#: Bytes of a text from which it is cut into tiles.
LONG_BYTES = 1 << 16
#: Words from one tile to the next in the low octaves: a power of two.
TILE_WORDS = 1 << 13

#: Bytes of texts that a task solves in one go.
SLICE_BYTES = 1 << 20

BLANKS = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

#: Fixed odd numbers that mix two names into one.
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def common_forwards(ids: np.ndarray, at: int, period: int) -> int:
    """How many words from ``at`` equal those ``period`` words further on."""
    return _agreeing(lambda done, size: (ids[at + done : at + done + size], ids[at + period + done : at + period + done + size]))


def common_backwards(ids: np.ndarray, at: int, period: int) -> int:
    """How many words before ``at`` equal those ``period`` words further on."""

    def pair(done: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        size = min(size, at - done)
        end = at - done
        return ids[end - size : end][::-1], ids[end - size + period : end + period][::-1]

    return _agreeing(pair)


def _agreeing(pair: Callable[[int, int], tuple[np.ndarray, np.ndarray]]) -> int:
    done, size = 0, 64
    while True:
        left, right = pair(done, size)
        n = min(len(left), len(right))
        differ = np.flatnonzero(left[:n] != right[:n])
        if len(differ):
            return done + int(differ[0])
        done += n
        if n < size:
            return done
        size *= 2


def joined_units(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of words longest first, each followed by a number of its own: (numbers, unit of each place, start of each)."""
    order = np.argsort(-sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes[order] + 1)])
    joined = np.empty(starts[-1], np.int64)
    ends = starts[1:] - 1
    joined[ends] = -1 - np.arange(len(order))
    inner = np.ones(len(joined), bool)
    inner[ends] = False
    joined[inner] = ids[stretches(begins[order], sizes[order])]
    return joined, order, starts


def runs_of_units(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, first_octave: int = 0, last_octave: int = 62) -> np.ndarray:
    """Rows (unit, start, end, period), sorted, of the maximal stretches inside each unit."""
    joined, order, starts = joined_units(ids, begins, sizes)
    names = joined.astype(np.uint64)
    longest_first = sizes[order]
    found: list[tuple[int, int, int]] = []
    for octave in range(last_octave + 1):
        step = 1 << octave
        units = int(np.searchsorted(-longest_first, -max(EXPONENT * step, LEAST), side="right"))
        used = int(starts[units])
        if not units or used <= 2 * step:
            break
        names = names[:used]
        mixed = names * LEFT
        mixed[:-step] ^= (names[step:] + RIGHT) * RIGHT
        mixed[-step:] = np.arange(step, dtype=np.uint64)  # beyond the last word: these end in no run
        names = mixed ^ (mixed >> np.uint64(29))
        if octave >= first_octave:
            found += _stretches_of_octave(joined[:used], names, step)
    if not found:
        return np.zeros((0, 4), np.int64)
    begin, end, period = np.array(sorted(set(found)), np.int64).T
    place = np.searchsorted(starts, begin, side="right") - 1
    rows = np.stack([order[place], begin - starts[place], end - starts[place], period], axis=1)
    return rows[np.lexsort([rows[:, 3], rows[:, 1], rows[:, 0]])]


def _stretches_of_octave(joined: np.ndarray, names: np.ndarray, step: int) -> list[tuple[int, int, int]]:
    """Maximal stretches with periods ``step`` to 2 * ``step`` - 1; ``names`` name 2 * ``step`` words each."""
    n = (len(names) - 2 * step) // step + 1
    windows = np.lib.stride_tricks.as_strided(names[1:], (n, 2 * step - 1), (8 * step, 8), writeable=False)
    same = windows == names[: n * step : step, None]
    candidates = np.flatnonzero(same.any(axis=1))
    smallest = same[candidates].argmax(axis=1) + 1
    found, reached = [], {}
    for boundary, shift in zip(candidates.tolist(), smallest.tolist()):
        at = boundary * step
        if reached.get(shift, -1) >= at + shift + 2 * step:
            continue  # inside the stretch found last
        while shift and not np.array_equal(joined[at : at + 2 * step], joined[at + shift : at + shift + 2 * step]):
            rest = np.flatnonzero(same[boundary, shift:])  # two names met by chance
            shift = int(rest[0]) + shift + 1 if len(rest) else 0
        if shift >= step:
            begin, end = at - common_backwards(joined, at, shift), at + shift + common_forwards(joined, at, shift)
            reached[shift] = end
            if end - begin >= max(LEAST, EXPONENT * shift):
                found.append((begin, end, shift))
    return found


def _check(octave_words: int) -> None:
    if octave_words < 16 or octave_words & (octave_words - 1):
        raise ValueError("words of a tile must be a power of two, 16 at least")


def find_periodic_runs(
    docs: DataFrame, id: str = "doc_id", text: str = "text", long_bytes: int = LONG_BYTES, tile_words: int = TILE_WORDS
) -> DataFrame:
    """Rows (id, ``runs``, ``collapsed``): runs by start and period, and the words left joined by one blank.

    Words are what ASCII white space separates, numbered from 0. A word is left out of ``collapsed`` if a run contains it
    after that run's first period.

    Edge cases: a NULL or empty text has no runs and is empty. Texts of any length are solved whole, in tiles. Equal or NULL
    identifiers and repeated rows are told apart and all returned. An empty table gives an empty one. Other columns are
    ignored.
    """
    _check(tile_words)
    docs = without(docs.select(id, text), "_row", "_runs")
    kind = docs.schema[id].dataType
    schema = f"`{id}` {kind.simpleString()}, runs {RUNS}, collapsed string"
    names = [id, "runs", "collapsed"]
    is_long = F.coalesce(F.octet_length(text) > long_bytes, F.lit(False))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(1), SLICE_BYTES):
                words = Words(part, BLANKS)
                found = runs_of_units(words.ids(), words.starts[:-1], np.diff(words.starts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), _listed(found, len(part)), collapsed(words, found)], names)
                done += len(part)
            release_memory()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words, runs = Words(batch.column(1).slice(i, 1), BLANKS), batch.column(2).slice(i, 1)
                flat = runs.flatten()
                begin, length, period = (flat.field(k).to_numpy() for k in range(3))
                found = np.stack([np.zeros(len(begin), np.int64), begin, begin + length, period], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pc.fill_null(runs, []).cast(pa.list_(RUN)), collapsed(words, found)], names)
        release_memory()

    short = docs.where(~is_long).mapInArrow(solve, schema)
    long = written(docs.where(is_long).withColumn("_row", F.monotonically_increasing_id()), "long-texts")
    runs = stitched(fragments(long, text, tile_words)).groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("_runs"))
    joined = long.join(runs, "_row", "left").select(id, text, F.coalesce("_runs", F.array().cast(RUNS)).alias("_runs"))
    return short.unionByName(joined.mapInArrow(finish, schema))


def _listed(found: np.ndarray, n: int) -> pa.Array:
    offsets = np.searchsorted(found[:, 0], np.arange(n + 1)).astype(np.int32)
    values = [pa.array(np.ascontiguousarray(x)) for x in (found[:, 1], found[:, 2] - found[:, 1], found[:, 3])]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(values, fields=list(RUN)))


def collapsed(words: Words, found: np.ndarray) -> pa.Array:
    """The words of each text that no run repeats, joined by one blank."""
    n = len(words.words)
    marks = np.zeros(n + 1, np.int32)
    base = words.starts[found[:, 0]]
    np.add.at(marks, base + found[:, 1] + found[:, 3], 1)
    np.add.at(marks, base + found[:, 2], -1)
    kept = np.cumsum(marks[:n]) == 0
    offsets = np.concatenate([[0], np.cumsum(kept)])[words.starts].astype(np.int32)
    left = words.words.filter(pa.array(kept)) if len(found) else words.words
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), left.cast(pa.string())), " ")


def fragments(rows: DataFrame, text: str, tile_words: int) -> DataFrame:
    """(_row, period, start, end): what each tile of each text sees of its runs."""
    shared = tile_words.bit_length() - 4  # the last octave of which eight times the step is within a tile

    def tiles(words: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
        top = max((len(words) // EXPONENT).bit_length() - 1, 0)
        levels = [(0, min(shared, top), tile_words)] + [(k, k, 8 << k) for k in range(shared + 1, top + 1)]
        for first, last, stride in levels:
            size = stride + (8 << last)
            for begin in range(0, max(len(words) - (8 << last), 1), stride):
                yield first, last, begin, words[begin : begin + size].tobytes()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                words = Words(batch.column(1).slice(i, 1), BLANKS).ids().astype("<i4")
                for first, last, begin, raw in tiles(words):
                    values = [batch.column(0).slice(i, 1), pa.array([first], pa.int32()), pa.array([last], pa.int32()), pa.array([begin], pa.int64()), pa.array([raw], pa.binary())]
                    yield pa.RecordBatch.from_arrays(values, ["_row", "first", "last", "begin", "words"])
        release_memory()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row, first, last, begin, raw = (batch.column(k)[i].as_py() for k in range(5))
                words = np.frombuffer(raw, "<i4")
                found = runs_of_units(words, np.zeros(1, np.int64), np.array([len(words)]), first, last)
                values = [np.full(len(found), row), found[:, 3], found[:, 1] + begin, found[:, 2] + begin]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64()) for x in values], ["_row", "period", "start", "end"])
        release_memory()

    exploded = rows.select("_row", text).mapInArrow(explode, "_row bigint, first int, last int, begin bigint, words binary")
    return exploded.repartition("_row", "first", "begin").mapInArrow(solve, "_row bigint, period bigint, start bigint, end bigint")


def stitched(parts: DataFrame) -> DataFrame:
    """(_row, period, start, length): fragments that overlap by a period at least are one run."""
    by_start = Window.partitionBy("_row", "period").orderBy("start", "end")
    before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > before - F.col("period"), F.lit(True))
    numbered = parts.withColumn("_opens", opens.cast("int")).withColumn("_run", F.sum("_opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("_row", "period", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.select("_row", "period", "start", (F.col("end") - F.col("start")).alias("length"))
