"""Collocations: phrases of two to five words that are more frequent than their parts let expect.

Texts are parsed prefix-free: wherever a digest of two neighbouring words has ``TRIGGER_BITS`` zero bits a new chunk begins, so equal
passages fall into equal chunks, wherever they stand. A chunk also holds the first words of the next one, as many as
the longest phrase has beyond its first word; a phrase belongs to the chunk in which its first word is an own one, and so is counted once.
Chunks make a dictionary with the number of times each was parsed, and phrases are counted inside distinct chunks,
times that number: a passage that a million documents share is looked at once.

Two readings of the dictionary count the phrases. The first counts pairs of words by a digest of 64 bits. Pairs that are
frequent by that count are marked in a bitmap of fixed size. The second counts words, and all phrases that consist of marked
pairs only, by their letters. Digests that fall together, or a full bitmap, only let more phrases be counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import Words, byte_table, release_memory, stretches, text_slices, without
from tidemark.session import written

LONGEST = 5
#: Of so many pairs of words, one begins a chunk: 2 to this power.
TRIGGER_BITS = 6
#: Own words of a chunk at most, where no pair begins a new one for long.
LONGEST_CHUNK = 4096
#: Bits of the bitmap of frequent pairs: 4 MB, in every task and once on the driver.
BITMAP_BITS = 25
#: Bytes of the dictionary that a task looks at in one go.
SLICE_BYTES = 4 << 20

# What ends a piece, and what parts words.
CUTS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
TEXT = byte_table(BLANKS, CUTS, lower=True)
CHUNK = byte_table(b"\x20", b"\x0a")

MIX, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def digests(values: pa.Array) -> np.ndarray:
    """64 bits for each of the binary values, told by their bytes alone."""
    coded = values.dictionary_encode()
    listed = coded.dictionary.to_numpy(zero_copy_only=False)
    made = pd.util.hash_array(listed, categorize=False) if len(listed) else np.zeros(0, np.uint64)
    return made[coded.indices.to_numpy()]


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    both = (left * MIX) ^ ((right + SPREAD) * SPREAD)
    both ^= both >> np.uint64(31)
    both *= MIX
    return both ^ (both >> np.uint64(29))


def chunk_begins(words: Words) -> np.ndarray:
    """Places of the words at which chunks begin: the first of each text, those whose pair is a trigger, and cuts of long chunks."""
    n = len(words.words)
    told = digests(words.words)
    begins = np.zeros(n + 1, bool)
    begins[: max(n - 1, 0)] = mixed(told[:-1], told[1:]) >> np.uint64(64 - TRIGGER_BITS) == 0
    begins[words.starts] = True
    places = np.flatnonzero(begins[:n])
    sizes = np.diff(np.append(places, n))
    extra = (sizes - 1) // LONGEST_CHUNK
    return np.repeat(places, extra + 1) + LONGEST_CHUNK * stretches(np.zeros(len(places), np.int64), extra + 1) if len(places) else places


def _spaced(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words as bytes with one blank or cut before each, and where that is (with the end of the last)."""
    ends = np.frombuffer(words.words.buffers()[1], np.int32, len(words.words) + 1).astype(np.int64)
    at = ends + np.arange(len(ends))
    data = np.empty(at[-1], np.uint8)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = False
    data[inner] = np.frombuffer(words.words.buffers()[2] or b"", np.uint8, ends[-1])
    data[at[:-1]] = np.where(words.cut, 10, 32)
    return data, at


def _strings(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of bytes, valid UTF-8, as an array of strings."""
    sizes = ends - begins
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[stretches(begins, sizes)])])


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, a place of each, the sum of its weights)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1) != 0) if len(keys) else order
    sums = np.add.reduceat(weights[order], first) if len(keys) else weights
    return ordered[first], order[first], sums


def parsed(texts: DataFrame) -> DataFrame:
    """(lang, own, chunk, n): the dictionary of chunks of texts (lang, text), with own words and times parsed of each."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(1)):
                words = Words(part, TEXT)
                langs = batch.column(0).slice(done, len(part))
                done += len(part)
                begins = chunk_begins(words)
                if not len(begins):
                    continue
                text_of = np.searchsorted(words.starts, begins, side="right") - 1
                last = words.starts[text_of + 1]
                own = np.minimum(np.append(begins[1:], len(words.words)), last) - begins
                data, at = _spaced(words)
                chunks = _strings(data, at[begins] + 1, at[np.minimum(begins + own + LONGEST - 1, last)]).dictionary_encode()
                coded = langs.dictionary_encode()
                lang = coded.indices.to_numpy()[text_of]
                keys = (chunks.indices.to_numpy().astype(np.int64) * len(coded.dictionary) + lang) * (LONGEST_CHUNK + 1) + own
                _, place, times = _summed(keys, np.ones(len(keys), np.int64))
                chosen = pa.array(place)
                columns = [coded.dictionary.take(pa.array(lang[place])), pa.array(own[place], pa.int32()), chunks.dictionary.take(chunks.indices.take(chosen)), pa.array(times)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "own", "chunk", "n"])
        release_memory()

    counted = texts.select("lang", "text").mapInArrow(parse, "lang string, own int, chunk string, n bigint")
    return counted.groupBy("lang", "own", "chunk").agg(F.sum("n").alias("n"))


class Pairs:
    """Words of some chunks, which are their chunk's own, and digests of neighbouring pairs."""

    def __init__(self, langs: pa.Array, own: np.ndarray, chunks: pa.Array, times: np.ndarray):
        self.words = Words(chunks, CHUNK)
        sizes = np.diff(self.words.starts)
        place = np.arange(len(self.words.words)) - np.repeat(self.words.starts[:-1], sizes)
        self.own = place < np.repeat(own, sizes)
        self.times = np.repeat(times, sizes)
        coded = langs.dictionary_encode()
        self.langs, self.lang = coded.dictionary, np.repeat(coded.indices.to_numpy(), sizes)
        self.joined = ~self.words.cut[1:]  # this word and the next are in one piece
        told = digests(self.words.words)
        lang_told = digests(coded.dictionary.cast(pa.binary()))[self.lang] if len(self.lang) else told
        self.digest = mixed(mixed(told[:-1], told[1:]), lang_told[:-1])


def chunk_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Pairs]:
    for batch in batches:
        done = 0
        for part in text_slices(batch.column(2), SLICE_BYTES):
            lang, own, times = (batch.column(i).slice(done, len(part)) for i in (0, 1, 3))
            done += len(part)
            yield Pairs(lang, own.to_numpy(), part, times.to_numpy())


def frequent_pairs(dictionary: DataFrame, least: int) -> np.ndarray:
    """A bitmap in 64-bit words: the first ``BITMAP_BITS`` bits of the digests of pairs that may be frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in chunk_slices(batches):
            valid = pairs.joined & pairs.own[:-1]
            keys, _, sums = _summed(pairs.digest[valid].view(np.int64), pairs.times[:-1][valid])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "n"])
        release_memory()

    counts = dictionary.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    slot = F.shiftrightunsigned("pair", 64 - BITMAP_BITS)
    bits = counts.select(F.shiftright(slot, 6).alias("place"), F.expr("shiftleft(1L, cast(pair >>> " + str(64 - BITMAP_BITS) + " as int) & 63)").alias("bit"))
    found = bits.groupBy("place").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most the fixed size of the bitmap
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bitmap[found["place"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def phrase_counts(dictionary: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(lang, phrase, words, f): words, and phrases of marked pairs, with their number of occurrences."""
    shared = dictionary.sparkSession.sparkContext.broadcast(bitmap.tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(shared.value, np.uint64)
        for pairs in chunk_slices(batches):
            n = len(pairs.words.words)
            if not n:
                continue
            slot = pairs.digest >> np.uint64(64 - BITMAP_BITS)
            hit = (marked[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
            linked = np.append(pairs.joined & (hit == 1), False)
            data, at = _spaced(pairs.words)
            ids = pairs.words.ids().astype(np.int64)
            names = ids * len(pairs.langs) + pairs.lang  # of the phrase that begins at each word
            unbroken = np.ones(n, bool)
            for size in range(1, LONGEST + 1):
                if size > 1:
                    unbroken = linked & np.append(unbroken[1:], False)
                    begins = np.flatnonzero(unbroken)
                    # The phrase is its first words' name and its last word; names are numbered anew.
                    _, numbered = np.unique(names[begins] * (ids.max() + 1) + ids[begins + size - 1], return_inverse=True)
                    names = np.zeros(n, np.int64)
                    names[begins] = numbered
                counted = np.flatnonzero(unbroken & pairs.own)
                _, place, sums = _summed(names[counted], pairs.times[counted])
                first = counted[place]
                phrases = _strings(data, at[first] + 1, at[first + size])
                columns = [pairs.langs.take(pa.array(pairs.lang[first])), phrases, pa.array(np.full(len(first), size, np.int32)), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "f"])
        release_memory()

    counted = dictionary.mapInArrow(count, "lang string, phrase string, words int, f bigint")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def mine_collocations(docs: DataFrame, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The best phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    ``a`` is the phrase's number of occurrences, at least ``least``; ``l`` and ``r`` are those of its two parts at the cut with the lowest
    ``score`` = floor(1000 a n / (l r)), the first such cut; ``n`` is the number of words of the language. Phrases that occur
    only inside one longer one are left out.

    Edge cases: a NULL or empty text has no words; a NULL language is ``und``. Repeated rows count each time. Words and chunks of
    any length are whole. Equal scores go by ``a``, then by the phrase's bytes. An empty table, or one without frequent
    phrases, gives no rows. Other columns are ignored, whatever their names.
    """
    texts = without(docs, "_lang").select(F.coalesce(lang, F.lit("und")).cast("string").alias("lang"), F.col(text).alias("text"))
    dictionary = written(parsed(texts), "chunks").select("lang", "own", "chunk", "n")
    frequent = phrase_counts(dictionary, frequent_pairs(dictionary, least)).where(F.col("f") >= least)
    counts = written(frequent, "phrases")
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("own") * F.col("n")).alias("n"))
    return best_phrases(counts, totals, top)


def best_phrases(counts: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    listed = F.split("phrase", " ")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), listed.alias("_list"))
    cut = candidates.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumn("_left", F.array_join(F.slice("_list", F.lit(1), F.col("_k")), " "))
    cut = cut.withColumn("_right", F.array_join(F.slice("_list", F.col("_k") + 1, F.col("words") - F.col("_k")), " "))
    left = counts.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    both = cut.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).join(totals, "lang")
    # Products pass 64 bits; decimals of 38 digits hold them.
    score = F.expr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r)").cast("bigint")
    lowest = F.min(F.struct(score.alias("score"), "_k", "l", "r", "n")).alias("_cut")
    scored = both.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.n", "_cut.score")

    sizes = F.sequence(F.lit(2), F.col("words") - 1)
    inner = candidates.where("words > 2").withColumn("_size", F.explode(sizes))
    inner = inner.withColumn("_at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("_size") + 1)))
    inner = inner.select("lang", F.array_join(F.slice("_list", F.col("_at"), F.col("_size")), " ").alias("phrase"), "a")
    kept = scored.join(inner, ["lang", "phrase", "a"], "left_anti")  # a longer phrase is as frequent, never more
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
