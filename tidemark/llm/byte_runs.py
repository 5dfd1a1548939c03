"""Exact removal of byte strings that occur in an earlier document, by blockwise suffix sorting.

Sorting every suffix of a corpus at once needs many times its size. Here suffixes are sorted bucket by
bucket. The bucket of a suffix is drawn from its first ``length`` bytes alone, by the smallest hash of
the ``ANCHOR`` byte strings among them, its anchor, so equal strings meet in one bucket. Neighbouring
suffixes mostly have the same anchor, and travel as one stretch of text: a bucket gets about four bytes
per suffix, each stretch once for all copies in a chunk of documents. Before that the anchors alone are
exchanged, as sorted numbers: a stretch whose anchor is in one document only can't repeat, and stays where it is.

Within a bucket, blocks of suffixes are sorted by their first ``COVER`` bytes. Longer ties are resolved
by a difference cover: for any two suffixes there is a shift below ``COVER`` after which both lie on
positions of a sample, and the sample's ranks, made beforehand from up to ``length`` bytes, tell the order
in one look. Neighbours in that order with the same first ``length`` bytes are one class, and the
smallest document of a class covers the bytes of all others.

What a task holds is bounded: a chunk of documents, or the distinct stretches of a bucket and one
block of its suffixes. Chunks are written to the shared folder and rebuilt alike by whoever reads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import plain_bytes, text_slices
from tidemark.session import written

CHUNK_BYTES = 6 << 20
BUCKET_BYTES = 2 << 20  # of the whole text; what repeats of it is less
SLAB = 1 << 20
BLOCK = 1 << 18
ANCHOR = 20
LONGEST = 64  # suffixes in a stretch at most: a bit each in a mask

#: Positions modulo 32 such that any two residues are met by some shift of both.
COVER = 32
COVER_SAMPLE = (1, 2, 3, 4, 8, 12, 20)

CHUNK = "chunk bigint, ids binary, named binary, sizes binary, data binary"
ANCHORS = "bucket int, chunk bigint, anchors binary"
FLAGS = "chunk bigint, bucket int, flags binary"
STRETCHES = "bucket int, chunk bigint, sizes binary, docs binary, data binary"
MASKS = "chunk bigint, bucket int, masks binary"
RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def remove_repeated_bytes(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each document.

    A byte of a text's UTF-8 form is removed if it is in a string of ``length`` bytes that also starts in a
    document with a smaller identifier. ``n_spans`` counts the maximal removed runs; ``kept`` has the
    other bytes, which may cut a character.

    Edge cases: a NULL text is empty. Texts shorter than ``length`` lose nothing. Rows with equal
    identifiers are the same document and take nothing from each other. A row with a NULL identifier
    takes part in nothing and loses nothing. A text longer than a chunk is a chunk by itself. Long
    runs of one byte are one stretch over and over. An empty table stays empty. Other columns are
    ignored.
    """
    if length < COVER:
        raise ValueError(f"length must be at least {COVER}")
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_buckets = max(1, -(-total // BUCKET_BYTES))
    chunks = written(_chunk_table(docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))), "chunks")
    anchors = chunks.mapInArrow(lambda batches: _send_anchors(batches, n_buckets, length), ANCHORS)
    flags = written(anchors.groupBy("bucket").applyInArrow(_flags_of_bucket, FLAGS), "anchor-flags")

    def send(own: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [_stretch_rows(row, answers, n_buckets, length) for row in own.to_pylist()]
        return pa.Table.from_batches([p for p in parts if p.num_rows], schema=_STRETCHES_ARROW)

    def cut(own: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_cut(row, answers, n_buckets, length) for row in own.to_pylist()], schema=_RESULT_ARROW)

    stretches = chunks.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(send, STRETCHES)
    masks = stretches.groupBy("bucket").applyInArrow(lambda table: _masks_of_bucket(table, length), MASKS)
    nothing = F.lit(None).cast("binary")
    answers = flags.withColumn("masks", nothing).unionByName(masks.withColumn("flags", nothing))
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(cut, RESULT)


# -- chunks ---------------------------------------------------------------------------------


def _chunk_table(docs: DataFrame) -> DataFrame:
    """Documents in chunks of about ``CHUNK_BYTES``, each chunk in the order of identifiers, one row per chunk."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(1), CHUNK_BYTES // 4):
                ids = batch.column(0).slice(done, len(part)).to_pylist()
                done += len(part)
                held += zip(ids, plain_bytes(part))
                size += part.nbytes
                if size >= CHUNK_BYTES:
                    yield _chunk_row(task << 32 | number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _chunk_row(task << 32 | number, held)

    return docs.mapInArrow(gather, CHUNK)


def _chunk_row(chunk: int, held: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
    held = sorted(held, key=lambda d: (d[0] is None, d[0] or 0))
    ids = np.array([d[0] or 0 for d in held], np.int64)
    named = np.array([d[0] is not None for d in held])
    sizes = np.array([len(d[1]) for d in held], np.int64)
    data = zstandard.ZstdCompressor(level=1).compress(b"".join(d[1] for d in held))
    row = {"chunk": chunk, "ids": ids.tobytes(), "named": named.tobytes(), "sizes": sizes.tobytes(), "data": data}
    return pa.RecordBatch.from_pylist([row], schema=_CHUNK_ARROW)


class _Chunk:
    """A chunk's bytes and documents, its anchors in the order of buckets, and its stretches, in an order anyone rebuilds alike."""

    def __init__(self, row: dict, n_buckets: int, length: int):
        self.length = length
        self.ids, self.named = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["named"], bool)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        n = int(self.ends[-1])
        raw = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(n, 1)) if n else b""
        self.data = np.frombuffer(raw + bytes(ANCHOR + 8), np.uint8)
        self.starts, self.counts, anchors = _stretches(self.data, n, self.ends, self.named, length)
        self.doc_of = np.searchsorted(self.ends, self.starts, side="right").astype(np.int32)
        # Bucket, and 32 bits of the anchor: two anchors taken for one cost a look, not a mistake.
        key = (anchors % np.uint64(n_buckets)) << np.uint64(32) | (anchors // np.uint64(n_buckets)) & np.uint64(0xFFFFFFFF)
        self.anchors, self.anchor_of = np.unique(key, return_inverse=True)

    def anchor_blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """The sorted anchors of each bucket."""
        bucket = (self.anchors >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
            yield int(bucket[a]), (self.anchors[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32)

    def keep_repeated(self, answers: pa.Table) -> None:
        """Leave the stretches whose anchor is in another document too, and number the distinct ones."""
        known = answers.filter(answers.column("flags").is_valid()).select(["bucket", "flags"]).to_pylist()
        unpack = zstandard.ZstdDecompressor().decompress
        flags = [np.frombuffer(unpack(x["flags"]), bool) for x in sorted(known, key=lambda x: x["bucket"])]
        flag = np.concatenate([np.zeros(0, bool), *flags])
        if len(flag) != len(self.anchors):
            raise ValueError(f"{len(flag)} answers to {len(self.anchors)} anchors")
        ids = self.ids[self.doc_of]
        low = np.full(len(flag), np.iinfo(np.int64).max)
        high = np.full(len(flag), np.iinfo(np.int64).min)
        np.minimum.at(low, self.anchor_of, ids)
        np.maximum.at(high, self.anchor_of, ids)
        chosen = (flag | (low < high))[self.anchor_of]
        bucket = (self.anchors >> np.uint64(32)).astype(np.int32)[self.anchor_of][chosen]
        self.starts, self.counts, self.doc_of = self.starts[chosen], self.counts[chosen], self.doc_of[chosen]
        coded = _binary_array(self.data, self.starts, self.counts + self.length - 1).dictionary_encode()
        self.code = coded.indices.to_numpy()
        first = np.full(len(coded.dictionary), len(self.starts), np.int64)
        np.minimum.at(first, self.code, np.arange(len(self.starts)))
        self.first = first  # documents are in order, so the first copy is in the smallest
        self.bucket = bucket[first]
        self.order = np.argsort(self.bucket, kind="stable")

    def first_docs(self) -> np.ndarray:
        return self.ids[self.doc_of[self.first]]


def _stretches(data: np.ndarray, n: int, ends: np.ndarray, named: np.ndarray, length: int):
    """Start, number of suffixes and anchor of each stretch of suffixes with one anchor."""
    found: list[tuple[np.ndarray, ...]] = []
    begins = np.concatenate([[0], ends[:-1]])
    # The last suffix of each document starts ``length`` bytes before its end; documents without a name have none.
    lasts = np.where(named, ends - length, begins - 1)
    for low in range(0, n, SLAB):
        high = min(low + SLAB, n)
        first, last = np.searchsorted(ends, [low, high - 1], side="right")
        edge = np.zeros(high - low + 1, np.int32)
        for doc in range(first, last + 1):
            a, b = max(begins[doc], low), min(lasts[doc] + 1, high)
            if a < b:
                edge[a - low] += 1
                edge[b - low] -= 1
        valid = np.cumsum(edge[:-1]) > 0
        if not valid.any():
            continue
        smallest = _smallest_anchor(data, low, high, length)
        fresh = np.ones(high - low, bool)
        fresh[1:] = (smallest[1:] != smallest[:-1]) | ~valid[:-1]
        opens = np.zeros(high - low, bool)
        inside = np.isin(begins, np.arange(low, high)) if len(begins) < 64 else (begins >= low) & (begins < high)
        opens[begins[inside] - low] = True
        fresh |= opens
        heads = np.flatnonzero(fresh & valid)
        run_start = np.zeros(high - low, np.int64)
        run_start[heads] = heads
        run_start = np.maximum.accumulate(run_start)
        heads = np.flatnonzero(valid & (fresh | ((np.arange(high - low) - run_start) % LONGEST == 0)))
        valid_before = np.concatenate([[0], np.cumsum(valid)])
        nexts = np.append(heads[1:], high - low)
        counts = valid_before[nexts] - valid_before[heads]
        found.append((heads + low, counts, _mix(smallest[heads])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _words(data: np.ndarray, kind: str) -> np.ndarray:
    """The eight bytes from each position on, as one number, in place."""
    return np.ndarray((len(data) - 7,), kind, data, strides=(1,))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _smallest_anchor(data: np.ndarray, low: int, high: int, length: int) -> np.ndarray:
    """For suffixes low to high: the smallest hash of the anchors within their first ``length`` bytes."""
    n_anchors = length - ANCHOR + 1
    stop = min(high + n_anchors - 1, len(data) - ANCHOR)
    words = _words(data, "<u8")
    hashes = np.zeros(stop - low, np.uint64)
    for at in [*range(0, ANCHOR - 8, 8), ANCHOR - 8]:
        hashes = _mix(hashes * np.uint64(0x9E3779B97F4A7C15) ^ words[low + at : stop + at].astype(np.uint64))
    least, width = hashes, 1
    while 2 * width <= n_anchors:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = n_anchors - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    out = np.full(high - low, np.iinfo(np.uint64).max, np.uint64)  # what is short of a whole window isn't valid
    out[: min(len(least), high - low)] = least[: high - low]
    return out


def _binary_array(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The stretches as an Arrow array, copied one behind the other."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    out = np.empty(int(offsets[-1]), np.uint8)
    step = 1 << 15
    for k in range(0, len(starts), step):
        a, b = offsets[k], offsets[min(k + step, len(starts))]
        part = slice(k, k + step)
        at = np.repeat(starts[part] - offsets[:-1][part], sizes[part])
        at += np.arange(a, b)
        out[a:b] = data[at]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large binary array that starts at its buffers' start."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int64, len(strings) + 1)
    return np.frombuffer(data, np.uint8, int(ends[-1])) if len(strings) else np.zeros(0, np.uint8), ends


def _send_anchors(batches: Iterator[pa.RecordBatch], n_buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            rows = [
                {"bucket": bucket, "chunk": row["chunk"], "anchors": pack(np.diff(anchors, prepend=np.uint32(0)).tobytes())}
                for bucket, anchors in _Chunk(row, n_buckets, length).anchor_blocks()
            ]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ANCHORS_ARROW)


def _flags_of_bucket(table: pa.Table) -> pa.Table:
    """For each chunk's anchors: whether another chunk has them too."""
    unpack = zstandard.ZstdDecompressor().decompress
    sent = [np.cumsum(np.frombuffer(unpack(x), np.uint32), dtype=np.uint32) for x in table.column("anchors").to_pylist()]
    values, counts = np.unique(np.concatenate(sent), return_counts=True)
    repeated = values[counts > 1]
    pack = zstandard.ZstdCompressor(level=1).compress
    flags = [pack(np.isin(x, repeated, assume_unique=True).tobytes()) for x in sent]
    return pa.table([table.column("chunk"), table.column("bucket"), pa.array(flags, pa.binary())], schema=_FLAGS_ARROW)


def _stretch_rows(row: dict, answers: pa.Table, n_buckets: int, length: int) -> pa.RecordBatch:
    """The chunk's distinct stretches by bucket, each with the smallest document that has it."""
    pack = zstandard.ZstdCompressor(level=1).compress
    chunk = _Chunk(row, n_buckets, length)
    chunk.keep_repeated(answers)
    docs, counts, starts = chunk.first_docs(), chunk.counts[chunk.first], chunk.starts[chunk.first]
    sent = chunk.bucket[chunk.order]
    cuts = np.flatnonzero(np.diff(sent, prepend=-1))
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(sent)]):
        own = chunk.order[a:b]
        text = _flat(_binary_array(chunk.data, starts[own], counts[own] + length - 1))[0]
        packed = (counts[own].astype(np.uint8), docs[own], text)
        rows.append({"bucket": int(sent[a]), "chunk": row["chunk"]} | dict(zip(("sizes", "docs", "data"), (pack(x.tobytes()) for x in packed))))
    return pa.RecordBatch.from_pylist(rows, schema=_STRETCHES_ARROW)


# -- buckets --------------------------------------------------------------------------------


def _masks_of_bucket(table: pa.Table, length: int) -> pa.Table:
    """For each stretch that a chunk sent: which of its suffixes start in a document before the chunk's first."""
    unpack = zstandard.ZstdDecompressor().decompress
    counts, docs, texts, lens = [], [], [], []
    for row in table.select(["sizes", "docs", "data"]).to_pylist():
        counts.append(np.frombuffer(unpack(row["sizes"]), np.uint8).astype(np.int64))
        docs.append(np.frombuffer(unpack(row["docs"]), np.int64))
        texts.append(unpack(row["data"]))
        lens.append(len(counts[-1]))
    count, doc = np.concatenate(counts), np.concatenate(docs)
    sizes = count + length - 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    joined = pa.Array.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(texts))])
    del texts
    coded = joined.dictionary_encode()
    code, distinct = coded.indices.to_numpy(), coded.dictionary
    first_doc = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(first_doc, code, doc)
    text, ends = _flat(distinct)
    windows = np.diff(ends) - length + 1
    smallest = _smallest_documents(text, ends, windows, first_doc, length)

    begins = (np.cumsum(windows) - windows)[code]
    cuts = np.concatenate([[0], np.cumsum(lens)])
    packed = [_masks(count[a:b], doc[a:b], begins[a:b], smallest) for a, b in zip(cuts, cuts[1:])]
    return pa.table([table.column("chunk"), table.column("bucket"), pa.array(packed, pa.binary())], schema=_MASKS_ARROW)


def _masks(count: np.ndarray, doc: np.ndarray, begins: np.ndarray, smallest: np.ndarray) -> bytes:
    """A chunk's stretches as bits: is the suffix in a document before the stretch's own?"""
    heads = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(heads, count)
    covered = smallest[np.repeat(begins, count) + place] < np.repeat(doc, count)
    masks = np.bitwise_or.reduceat(covered.astype(np.uint64) << place.astype(np.uint64), heads)
    return zstandard.ZstdCompressor(level=1).compress(masks.tobytes())


def _smallest_documents(text: np.ndarray, ends: np.ndarray, windows: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """For each suffix (``windows`` of them in each stretch): the smallest document of those with the same first bytes."""
    text = np.concatenate([text, np.zeros(length + 16, np.uint8)])
    suffixes = np.repeat(ends[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    owner = np.repeat(np.arange(len(windows)), windows)
    smallest = docs[owner]
    for block in _blocks(text, suffixes):
        order, heads = _sorted_by_prefix(text, suffixes, block)
        if len(order):
            at = suffixes[order]
            ranks = _sample_ranks(text, at, ends[owner[order] + 1], length)
            shifted, heads = _resolved(at, heads, ranks)
            order, at = order[shifted], at[shifted]
            heads[1:] &= ~_same_bytes(text, at[1:], at[:-1], length)
            first = np.flatnonzero(heads)
            least = np.minimum.reduceat(smallest[order], first)
            smallest[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    return smallest


def _blocks(text: np.ndarray, suffixes: np.ndarray) -> Iterator[np.ndarray]:
    """Suffixes (by place) in ranges of their first eight bytes, each of about ``BLOCK``; equal ones stay together."""
    key = _words(text, ">u8")[suffixes].astype(np.uint64)
    n_blocks = -(-len(suffixes) // BLOCK)
    if n_blocks <= 1:
        yield np.arange(len(suffixes))
        return
    sample = np.sort(key[:: max(1, len(key) // (64 * n_blocks))])
    splitters = np.unique(sample[np.arange(1, n_blocks) * len(sample) // n_blocks])
    block = np.searchsorted(splitters, key, side="right")
    order = np.argsort(block, kind="stable")
    cuts = np.searchsorted(block[order], np.arange(len(splitters) + 2))
    for a, b in zip(cuts, cuts[1:]):
        yield order[a:b]


def _sorted_by_prefix(text: np.ndarray, suffixes: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort a block by the first ``COVER`` bytes; keep those that others share, and mark the first of each tie."""
    words = _words(text, ">u8")
    order, group = block, np.zeros(len(block), np.int64)
    for k in range(COVER // 8):
        key = words[suffixes[order] + 8 * k].astype(np.uint64)
        by = np.argsort(key) if not k else np.lexsort([key, group])
        order, key, group = order[by], key[by], group[by]
        heads = np.ones(len(order), bool)
        heads[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        alone = heads & np.append(heads[1:], True)
        order, heads = order[~alone], heads[~alone]
        group = np.cumsum(heads)
    return order, heads


_RESIDUE_IN_COVER = np.isin(np.arange(COVER), COVER_SAMPLE)
_SHIFT = np.array(
    [
        [next(d for d in range(COVER) if _RESIDUE_IN_COVER[(i + d) % COVER] and _RESIDUE_IN_COVER[(j + d) % COVER]) for j in range(COVER)]
        for i in range(COVER)
    ]
)


def _sample_ranks(text: np.ndarray, suffixes: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the cover's positions within reach of these suffixes, by up to ``length`` bytes; a stretch's end sorts first."""
    ranks = np.zeros(len(text), np.int32)
    reach = np.zeros(len(text), np.int64)
    for d in range(COVER):
        at = suffixes + d
        chosen = _RESIDUE_IN_COVER[at % COVER]
        reach[at[chosen]] = ends[chosen]
    sample = np.flatnonzero(reach)
    room = reach[sample] - sample
    del reach
    words, order, group = _words(text, ">u8"), np.arange(len(sample)), np.zeros(len(sample), np.int64)
    rank = np.zeros(len(sample), np.int64)  # places of the sorted; ties share one until a later word parts them
    kept_bits = np.array([0, *(((1 << 8 * b) - 1) << (64 - 8 * b) for b in range(1, 9))], np.uint64)
    for k in range(-(-length // 8) + 1):
        left = np.clip(np.minimum(room[order], length) - 8 * k, 0, 8)
        key = words[np.minimum(sample[order] + 8 * k, len(words) - 1)].astype(np.uint64) & kept_bits[left]
        # Nine values of ``left`` part a text's end from bytes of zero.
        by = np.lexsort([left, key, group])
        order, key, left, group = order[by], key[by], left[by], group[by]
        heads = np.ones(len(order), bool)
        heads[1:] = (key[1:] != key[:-1]) | (left[1:] != left[:-1]) | (group[1:] != group[:-1])
        # A tie shares the rank of its first; its parts move up by the number of those before them in it.
        place, old = np.arange(len(order)), np.ones(len(order), bool)
        old[1:] = rank[order][1:] != rank[order][:-1]
        rank[order] += np.maximum.accumulate(np.where(heads, place, 0)) - np.maximum.accumulate(np.where(old, place, 0))
        alone = heads & np.append(heads[1:], True)
        order, group = order[~alone], np.cumsum(heads)[~alone]
        if not len(order):
            break
    ranks[sample] = rank
    return ranks


def _resolved(suffixes: np.ndarray, heads: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort within ties by the sample's ranks: three-way partitions of all ties at once, around one suffix each."""
    places, heads = np.arange(len(suffixes)), heads.copy()
    slots = np.arange(len(suffixes))
    while len(slots):
        first = np.flatnonzero(heads[slots] | np.append(True, np.diff(slots) > 1))
        sizes = np.diff(np.append(first, len(slots)))
        own = suffixes[places[slots]]
        pivot = np.repeat(own[first + sizes // 2], sizes)
        shift = _SHIFT[own % COVER, pivot % COVER]
        side = np.sign(ranks[own + shift] - ranks[pivot + shift])
        group = np.repeat(np.arange(len(first)), sizes)
        by = np.lexsort([side, group])
        places[slots], side, group = places[slots][by], side[by], group[by]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = (side[1:] != side[:-1]) | (group[1:] != group[:-1])
        heads[slots] = fresh
        alone = fresh & np.append(fresh[1:], True)
        slots = slots[(side != 0) & ~alone]
    return places, heads


def _same_bytes(text: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    words = _words(text, ">u8")
    same = np.ones(len(left), bool)
    for start in [*range(0, length - 7, 8), length - 8]:
        same &= words[left + start] == words[right + start]
    return same


# -- documents ------------------------------------------------------------------------------


def _cut(row: dict, answers: pa.Table, n_buckets: int, length: int) -> pa.RecordBatch:
    chunk = _Chunk(row, n_buckets, length)
    chunk.keep_repeated(answers)
    masks = answers.filter(answers.column("masks").is_valid())
    unpack = zstandard.ZstdDecompressor().decompress
    by_bucket = sorted(zip(masks.column("bucket").to_pylist(), masks.column("masks").to_pylist()))
    sent = np.frombuffer(b"".join(unpack(mask) for _, mask in by_bucket), np.uint64)
    if len(sent) != len(chunk.order):
        raise ValueError(f"chunk {row['chunk']}: {len(sent)} answers to {len(chunk.order)} stretches")
    mask = np.zeros(len(sent), np.uint64)
    mask[chunk.order] = sent
    # Copies in a later document of the chunk are covered by the first one.
    later = chunk.ids[chunk.doc_of] > chunk.first_docs()[chunk.code]
    own = np.where(later, np.uint64(0xFFFFFFFFFFFFFFFF), mask[chunk.code])
    n = int(chunk.ends[-1])
    edge = np.zeros(n + 1, np.int32)
    for k in range(LONGEST):
        hit = chunk.starts[(chunk.counts > k) & ((own >> np.uint64(k)) & np.uint64(1) == 1)] + k
        edge[hit] += 1
        edge[hit + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    begins = chunk.ends - chunk.sizes
    rows = []
    for doc, (a, b) in enumerate(zip(begins.tolist(), chunk.ends.tolist())):
        out = gone[a:b]
        kept = chunk.data[a:b][~out]
        spans = int(out[0]) + int((out[1:] & ~out[:-1]).sum()) if b > a else 0
        rows.append((int(chunk.ids[doc]) if chunk.named[doc] else None, b - a, int(out.sum()), spans, kept.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT_ARROW)], schema=_RESULT_ARROW)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])


_CHUNK_ARROW, _ANCHORS_ARROW, _FLAGS_ARROW, _STRETCHES_ARROW, _MASKS_ARROW, _RESULT_ARROW = map(
    _arrow, (CHUNK, ANCHORS, FLAGS, STRETCHES, MASKS, RESULT)
)
