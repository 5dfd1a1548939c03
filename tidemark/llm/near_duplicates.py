"""Near duplicates by MinHash bands, odd sketches and exact confirmation.

Texts become sets of five-word shingles. Equal word sequences form one class from the start, however
many copies there are; only one text of a class goes on. ``BANDS`` bands of ``ROWS`` MinHash samples
each bring together classes that are likely to be similar, and the samples folded into a parity bitmap, the
odd sketch, tell how similar: the population count of two sketches' XOR estimates how many samples
differ, most precisely where nearly all agree. Candidates far below the limit are dropped by
the estimate; all others are confirmed on their full sets.

In a band bucket each class is first compared with the smallest one only. Components of those links
take in nearly all copies. Classes whose buckets still hold several components are then joined on the
first shingles of their sets in one order, rare ones first, which finds every pair that can be a link;
pairs inside a component need no comparison. So no link between components is lost, and the copies of
one text, of which most are linked or else have many shingles of their own, don't meet in pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tidemark.llm.arrays import release_memory, text_slices, without
from tidemark.llm.components import components
from tidemark.session import written

SHINGLE = 5
SAMPLES = 256
BANDS, ROWS = 50, 5  # a pair of similarity 0.85 shares no band with a chance of 2e-13; one of 0.8, 2e-9
SKETCH_BITS = 1024
SIGMAS = 6  # errors of the estimate allowed for before a candidate is dropped

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_draw = np.random.default_rng(20240229)
_FLIP = _draw.integers(0, 2**64, SAMPLES, dtype=np.uint64)
_SPREAD = _draw.integers(0, 2**64, SAMPLES, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def link_near_duplicates(docs: DataFrame, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each document.

    Two documents are linked if 100 * shared shingles >= ``percent`` * shingles of either or both.
    ``component_id`` is the smallest identifier that can be reached over links, ``kept`` whether it is
    the document's own.

    Edge cases: a text with fewer than five words has its whole sequence as its one shingle; a NULL
    text, or one without words, has none and is linked with nothing. Rows with equal identifiers
    count as one document and keep a row each. A row with a NULL identifier is linked with nothing:
    its component is NULL, and it is kept. An empty table stays empty. Very long texts are hashed
    whole, in a few numbers of 8 bytes a word. Other columns are ignored.
    """
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    marks = written(signatures(texts), "signatures")
    named = marks.where("n_shingles > 0 AND id IS NOT NULL")
    first = [F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")]
    classes = written(named.groupBy("words").agg(F.min("id").alias("id"), *first), "text-classes")
    parts = components(find_links(classes, texts, percent))
    component = F.coalesce("component", "class_id")
    of_class = classes.select("words", F.col("id").alias("class_id")).join(parts, F.col("class_id") == F.col("node"), "left")
    of_class = of_class.select("words", component.alias("component"))
    found = marks.select("id", "n_shingles", "words").join(of_class, "words", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    found = found.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component of ``link_near_duplicates``.

    Edge cases are as there. Rows with equal identifiers are one document: all of them stay if any one of them is kept, so no text is
    lost whose like isn't kept. Rows without text, words or identifier stay. Other columns pass through.
    """
    linked = link_near_duplicates(docs, percent, id, text).where(F.col(id).isNotNull())
    dropped = linked.groupBy(F.col(id).alias("_dropped")).agg(F.bool_or("kept").alias("_any")).where("not _any").select("_dropped")
    return docs.join(dropped, docs[id] == dropped["_dropped"], "left_anti")


def find_links(classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes, enough of them to have the components of all links."""
    bands = classes.select("id", "n_shingles", F.explode("bands").alias("band"))
    heads = bands.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head < last").drop("last")
    shared = written(bands.join(heads, "band"), "shared-bands")
    wanted = shared.select("id").distinct()
    candidates = classes.join(wanted, "id", "left_semi").select("id", "n_shingles", "sketch")
    candidates = written(candidates.join(texts, "id"), "candidates")

    compared = shared.where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links = written(confirmed(compared, candidates, percent), "confirmed")

    parts = components(links)
    placed = shared.join(parts, F.col("id") == F.col("node"), "left").select("band", "id", F.coalesce("component", "id").alias("part"))
    split = placed.groupBy("band").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("band")
    apart = placed.join(split, "band", "left_semi").select("id", "part").distinct()
    across = pairs_across(candidates.join(apart, "id"), percent).join(compared, ["a", "b"], "left_anti")
    return links.union(confirmed(across, candidates, percent))


def pairs_across(docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of different ``part`` that can be links: all links are among them.

    All shingles are put in one order: those of one part only, then others by how many documents
    have them. A document whose set has n shingles shares ``percent`` percent of them with any
    it is linked with, so the first they share is among the first n - percent * n / 100 + 1 of both. Those
    alone are joined, and only where enough of both sets follows. A copy with many changes begins with
    shingles that only it has, and so meets nobody, however many copies there are of what it was made from.
    """
    hashes = F.arrow_udf(_shingle_lists, "array<bigint>")(F.col("text"))
    sets = written(docs.select("id", "part", "n_shingles", hashes.alias("s")), "shingles")
    rows = sets.select("id", "part", "n_shingles", F.explode("s").alias("s"))
    spread = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("part").alias("least"), F.max("part").alias("most"))
    common = rows.join(spread.where("least < most").select("s", "df"), "s")
    of_doc = Window.partitionBy("id", "part")
    places = common.select(
        "id", "part", "n_shingles", "s", F.count(F.lit(1)).over(of_doc).alias("n"), F.row_number().over(of_doc.orderBy("df", "s")).alias("place")
    )
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    places = places.withColumn("place", F.col("place") + F.col("n_shingles") - F.col("n"))
    prefix = written(places.where(F.col("place") <= first).select("s", "id", "part", "n_shingles", "place"), "prefixes")
    x, y = prefix.alias("x"), prefix.alias("y")
    alike = F.least("x.n_shingles", "y.n_shingles") * 100 >= F.greatest("x.n_shingles", "y.n_shingles") * percent
    # Where the first shared shingle stands, what follows it must still be enough for a link.
    left = F.least(F.col("x.n_shingles") - F.col("x.place"), F.col("y.n_shingles") - F.col("y.place")) + 1
    enough = left * (100 + percent) >= (F.col("x.n_shingles") + F.col("y.n_shingles")) * percent
    on = (F.col("x.s") == F.col("y.s")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.part") != F.col("y.part")) & alike & enough
    return x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def _shingle_lists(texts: pa.Array) -> pa.Array:
    sets = pa.array([shingle_set(text.as_py()).view(np.int64) for text in texts], pa.list_(pa.int64()))
    release_memory()
    return sets


def confirmed(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: by size and estimate first, then on their full sets."""
    marks = candidates.select("id", "n_shingles", "sketch").distinct()
    left = marks.withColumnsRenamed({"id": "a", "n_shingles": "n_a", "sketch": "sketch_a"})
    right = marks.withColumnsRenamed({"id": "b", "n_shingles": "n_b", "sketch": "sketch_b"})
    sized = pairs.join(left, "a").join(right, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    likely = sized.where(F.arrow_udf(estimated_similarity, "double")("sketch_a", "sketch_b") >= least_estimate(percent)).select("a", "b")
    likely = written(likely.distinct(), "likely")
    texts = candidates.select("id", "text")
    both = likely.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")

    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        of = lru_cache(8)(shingle_set)
        found = [_similar(of(x.as_py()), of(y.as_py()), percent) for x, y in zip(left, right)]
        of.cache_clear()
        release_memory()
        return pa.array(found, pa.bool_())

    return both.where(F.arrow_udf(similar, "boolean")("text_a", "text_b")).select("a", "b").distinct()


def _similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * shared >= percent * (len(left) + len(right) - shared)


def least_estimate(percent: int) -> float:
    """Estimates below this are not seen for pairs at the limit, but for errors of more than ``SIGMAS``.

    The error is that of the share of equal samples and that of the sketch, whose bits collide at random.
    """
    s = percent / 100
    sampling = s * (1 - s) / SAMPLES
    differing = 2 * SAMPLES * (1 - s)
    collisions = differing**2 / (2 * SKETCH_BITS) / (2 * SAMPLES) ** 2
    return s - SIGMAS * (sampling + collisions) ** 0.5


def estimated_similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    """Similarity from the odd bits of two sketches' XOR."""
    bits = [np.frombuffer(b"".join(x.to_pylist()), np.uint64).reshape(len(x), -1) for x in (left, right)]
    odd = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
    share = np.minimum(2 * odd / SKETCH_BITS, 1 - 1e-9)
    return pa.array(1 + SKETCH_BITS / (4 * SAMPLES) * np.log(1 - share))


def signatures(texts: DataFrame) -> DataFrame:
    """(id, n_shingles, words, bands, sketch) per row; ``words`` is a digest of the word sequence."""
    kind = texts.schema["id"].dataType
    schema = pa.schema(
        [("id", to_arrow_type(kind)), ("n_shingles", pa.int64()), ("words", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), *_signed(part)], schema=schema)
                done += len(part)
        release_memory()

    return texts.mapInArrow(sign, f"id {kind.simpleString()}, n_shingles bigint, words binary, bands array<bigint>, sketch binary")


def _lowered(texts: pa.Array) -> list[bytes]:
    raw = pc.fill_null(texts.cast(pa.binary()), b"").to_pylist()
    return [b" ".join(text.translate(_LOWER).split()) for text in raw]


def shingle_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of all texts (words with single blanks), and where each text's begin."""
    split = pc.ascii_split_whitespace(pa.array([line.decode() for line in lines], pa.string()))
    coded = split.flatten().dictionary_encode()
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = of_word[coded.indices.to_numpy()]
    begins = split.offsets.to_numpy().astype(np.int64)
    counts = np.array([n if line else 0 for line, n in zip(lines, np.diff(begins))], np.int64)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(begins[:-1] - starts[:-1], sizes) + np.arange(starts[-1])
    mixed = np.zeros(len(at), np.uint64)
    ends = np.repeat(begins[:-1] + counts, sizes)
    for k in range(SHINGLE):
        inside = at + k < ends
        word = np.where(inside, words[np.minimum(at + k, len(words) - 1)], np.uint64(0)) if len(words) else mixed
        mixed = _mix(mixed * np.uint64(3) + word + np.uint64(k))
    return mixed, starts


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(_lowered(pa.array([text], pa.string())))[0])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _signed(texts: pa.Array) -> list[pa.Array]:
    lines = _lowered(texts)
    hashes, starts = shingle_hashes(lines)
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(lines)), sizes)
    order = np.lexsort([hashes, owner])
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][fresh], minlength=len(lines)).astype(np.int64)
    full = np.flatnonzero(sizes > 0)
    samples = np.zeros((SAMPLES, len(full)), np.uint64)
    for i in range(SAMPLES if len(full) else 0):
        samples[i] = np.minimum.reduceat((hashes ^ _FLIP[i]) * _SPREAD[i], starts[full])
    bands, sketches = _bands(samples), _odd_sketches(samples)
    lists = pa.ListArray.from_arrays(
        np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32), pa.array(bands.ravel())
    )
    sketch = [b""] * len(lines)
    for place, bits in zip(full.tolist(), sketches):
        sketch[place] = bits
    digests = [hashlib.blake2b(line, digest_size=16).digest() for line in lines]
    return [pa.array(distinct), pa.array(digests, pa.binary()), lists, pa.array(sketch, pa.binary())]


def _bands(samples: np.ndarray) -> np.ndarray:
    """One number per band and text; the band's place is part of it."""
    grouped = samples[: BANDS * ROWS].reshape(BANDS, ROWS, -1)
    mixed = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], grouped.shape[2], axis=1) * _STEP
    for k in range(ROWS):
        mixed = _mix(mixed + grouped[:, k] * _STEP)
    return np.ascontiguousarray(mixed.T).view(np.int64)


def _odd_sketches(samples: np.ndarray) -> list[bytes]:
    """For each text, the parities of how many samples fall on each of ``SKETCH_BITS`` bits."""
    salted = _mix(samples + np.arange(SAMPLES, dtype=np.uint64)[:, None] * _STEP)
    bit = (salted % np.uint64(SKETCH_BITS)).astype(np.int64)
    n = samples.shape[1]
    counts = np.bincount((bit + np.arange(n) * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS)
    packed = np.packbits((counts & 1).astype(bool).reshape(n, SKETCH_BITS), axis=1)
    return [row.tobytes() for row in packed]
