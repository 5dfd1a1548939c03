"""Benchmark decontamination with one Aho-Corasick automaton.

Test questions and answers and the corpus are normalised alike: ASCII letters in lower case, and
everything but letters, digits and non-ASCII characters taken as a blank between words. The windows
of ten consecutive words of all items (a shorter item is one window) are the words of one automaton,
which runs once over each text and reports every occurrence of every window. Hits are mapped back to
places in the original text.

The corpus isn't shuffled. The benchmark reaches the tasks as broadcasts of at most ``block_bytes``
of item text each; a larger benchmark makes several, each with an automaton of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import plain_bytes, release_memory, text_slices, without

#: Bytes to normalised bytes. Those of non-ASCII characters stay.
NORMALISE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS = "struct<n_words: bigint, items: array<string>, hits: array<struct<first: int, last: int, start: int, end: int>>>"
HITS_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("hits", pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")]))),
    ]
)


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``hit_items`` and ``hit_spans`` to each document.

    ``n_hit`` counts the words inside any occurrence of a window; ``hit_items`` has the ids (as
    strings, sorted, each once) of items with such a window; ``hit_spans`` has the hit stretches,
    as (first word, last word, start, end) with code points of the original text, end exclusive.

    Edge cases: a NULL or empty text has no words and no hits. An item without words (NULL too)
    never hits; items with equal windows all hit; a NULL item id shows as "null". Repeated rows get
    equal results. With an empty benchmark nothing hits, and an empty corpus stays empty. A very
    long text is scanned in linear time. Input columns named as an added one are replaced.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")
    )
    blocks = [spark.sparkContext.broadcast(windows) for windows in _blocks(items, window, block_bytes)]
    added = ("n_words", "n_hit", "hit_items", "hit_spans")
    kept = without(docs, *added, "_hits")

    def scanner(block):
        @F.arrow_udf(HITS)
        def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            automaton = window_automaton(block.value if block else {})
            for texts in batches:
                parts = [_scan(part, automaton) for part in text_slices(texts)]
                yield pa.concat_arrays(parts) if parts else pa.array([], HITS_ARROW)
            del automaton
            release_memory()

        return scan

    names = [f"_hits{i}" for i in range(max(1, len(blocks)))]
    scans = {name: scanner(block)(F.col(text)) for name, block in zip(names, blocks or [None])}
    found = [F.col(name) for name in names]
    items_hit = found[0].items if len(found) == 1 else F.array_distinct(F.concat(*[f.getField("items") for f in found]))
    spans = merged(found[0].hits if len(found) == 1 else F.concat(*[f.getField("hits") for f in found]))
    columns = [F.col(f"`{c}`") for c in kept.columns]
    result = kept.withColumns(scans).select(
        *columns, found[0].n_words.alias("n_words"), F.array_sort(items_hit).alias("hit_items"), spans.alias("hit_spans")
    )
    covered = F.aggregate("hit_spans", F.lit(0), lambda n, s: n + s.last - s.first + 1).cast("bigint")
    return result.select(*columns, "n_words", covered.alias("n_hit"), "hit_items", "hit_spans")


def merged(hits):
    """Stretches of hit words, where touching and overlapping ones are one."""
    ordered = F.array_sort(hits)
    return F.aggregate(
        ordered,
        F.filter(ordered, lambda h: F.lit(False)),
        lambda done, h: F.when(F.size(done) == 0, F.array(h))
        .when(F.element_at(done, -1).last + 1 < h.first, F.concat(done, F.array(h)))
        .otherwise(
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1).first.alias("first"),
                        F.greatest(F.element_at(done, -1).last, h.last).alias("last"),
                        F.element_at(done, -1).start.alias("start"),
                        F.greatest(F.element_at(done, -1).end, h.end).alias("end"),
                    )
                ),
            )
        ),
    )


def _blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[dict[str, tuple[int, list[str]]]]:
    """Windows with their lengths and items, for items of at most ``block_bytes`` at a time."""
    windows: dict[str, tuple[int, list[str]]] = {}
    size = 0
    for row in items.toLocalIterator():
        words = row.text.encode().translate(NORMALISE).split()
        size += len(row.text)
        for start in range(max(1, len(words) - window + 1) if words else 0):
            part = words[start : start + window]
            ids = windows.setdefault(f" {b' '.join(part).decode('latin-1')} ", (len(part), []))[1]
            if not ids or ids[-1] != row.id:
                ids.append(row.id)
        if size >= block_bytes:
            yield windows
            windows, size = {}, 0
    if windows:
        yield windows


def window_automaton(windows: dict[str, tuple[int, list[str]]]) -> ahocorasick.Automaton | None:
    if not windows:
        return None
    automaton = ahocorasick.Automaton()
    for words, value in windows.items():
        automaton.add_word(words, value)
    automaton.make_automaton()
    return automaton


def _scan(texts: pa.Array, automaton: ahocorasick.Automaton | None) -> pa.Array:
    rows = []
    for place, raw in enumerate(plain_bytes(texts)):
        words = raw.translate(NORMALISE).split()
        line = f" {b' '.join(words).decode('latin-1')} "
        found = list(automaton.iter(line)) if automaton and words else ()
        row = {"n_words": len(words), "items": [], "hits": []}
        if found:
            row["items"] = sorted({item for _, (_, items) in found for item in items})
            row["hits"] = _placed(line, found, raw.decode())
        rows.append(row)
    return pa.array(rows, HITS_ARROW)


def _placed(line: str, found: list, original: str) -> list[dict]:
    """Stretches of hit words, with their places in the original text."""
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(blanks, [end for end, _ in found]) - 1
    edge = np.zeros(len(blanks), np.int64)
    np.add.at(edge, last - np.array([n for _, (n, _) in found]) + 1, 1)
    np.add.at(edge, last + 1, -1)
    hit = np.diff(np.concatenate([[0], np.cumsum(edge) > 0, [0]]).astype(np.int8))
    words = [m.span() for m in _WORD.finditer(original)]
    return [
        {"first": int(a), "last": int(b) - 1, "start": words[a][0], "end": words[b - 1][1]}
        for a, b in zip(np.flatnonzero(hit == 1), np.flatnonzero(hit == -1))
    ]
