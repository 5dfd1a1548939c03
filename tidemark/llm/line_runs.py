"""Repeated runs of lines, found by prefix doubling over sequences of line ids.

A document is a sequence of line ids. Doubling names runs of 1, 2, 4, ... lines: the name of a run of
2^(k+1) lines is made of the names of its two halves, so equal names mean equal runs, and the
positions that share a name are an interval of the suffix array whose common prefix has that many
lines. After each step a position whose name is unique is dropped: no longer run that starts there
can repeat. Only repeated text is carried on, as (document, line number, name) rows; the texts stay
where they are until the end.

A run counts as repeated if it holds at least ``least_words`` words and also starts at an earlier place:
a smaller document, or further up in the same one. Every line of every such run is deleted. It is
enough to look at the shortest runs of so many words that start or end at each line: together they
cover each maximal run. Their names come from two overlapping runs of 2^k lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from tidemark.llm.arrays import release_memory, text_slices, without
from tidemark.session import written

REMOVED = "struct<text: string, n_lines: bigint, n_removed: bigint, n_runs: bigint>"
REMOVED_ARROW = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_runs", pa.int64())])
KEY = ["_doc", "_tag"]


def remove_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least_words: int = 50) -> DataFrame:
    """Delete repeated runs of lines from each text; add ``n_lines``, ``n_removed`` and ``n_runs``.

    ``n_lines`` counts the lines of the old text, ``n_removed`` those deleted, ``n_runs`` the
    stretches they made. Lines are compared as they stand; words are what white space separates.

    Edge cases: a NULL text stays NULL and has no lines; an empty text has one line. A document that
    only repeats others becomes empty but stays. Rows with the same identifier and the same text are
    one document and get the same result; with different texts they are ordered by a hash of the
    text. NULL identifiers come first. Lines without words repeat only as parts of longer runs. An
    empty table stays empty. Other columns pass through; those named as added ones are replaced.
    """
    kept = without(docs, "n_lines", "n_removed", "n_runs", "_doc", "_tag", "_cuts")
    keyed = kept.withColumns({"_doc": F.col(id), "_tag": F.coalesce(F.xxhash64(F.col(text), F.length(text)), F.lit(0))})
    runs = repeated_runs(keyed.select(*KEY, F.col(text).alias("text")), least_words)
    cuts = runs.groupBy(*KEY).agg(F.collect_set(F.struct("first", "n")).alias("_cuts"))
    matched = keyed.alias("d").join(
        cuts.alias("c"), F.col("d._doc").eqNullSafe(F.col("c._doc")) & (F.col("d._tag") == F.col("c._tag")), "left"
    )
    columns = [F.col(f"d.`{c}`") for c in kept.columns]
    cut = matched.select(*columns, F.arrow_udf(_without_runs, REMOVED)(F.col(f"d.`{text}`"), F.col("_cuts")).alias("_cut"))
    texts = [F.col("_cut.text").alias(c) if c == text else F.col(f"`{c}`") for c in kept.columns]
    return cut.select(*texts, "_cut.n_lines", "_cut.n_removed", "_cut.n_runs")


def repeated_runs(docs: DataFrame, least_words: int) -> DataFrame:
    """(_doc, _tag, first, n): shortest repeated runs of enough words that aren't the first of their kind."""
    lines = written(line_rows(docs, least_words).dropDuplicates([*KEY, "line"]), "lines")
    names = written(only_repeated(lines.select(*KEY, "line", "name")), "line-names")
    ahead = lines.where("ahead > 0").select(*KEY, F.col("line").alias("first"), F.col("ahead").alias("n"))
    behind = lines.where("behind > 0").select(*KEY, (F.col("line") - F.col("behind") + 1).alias("first"), F.col("behind").alias("n"))
    shortest = ahead.union(behind).distinct()
    start = names.select(*KEY, F.col("line").alias("first"))
    windows = written(same_place(shortest, start, "first", "left_semi"), "line-windows")
    longest = windows.agg(F.max("n")).first()[0] or 0

    named, step, level = None, 1, names
    while step <= longest:
        fitting = windows.where((F.col("n") >= step) & (F.col("n") < 2 * step))
        here = _window_names(fitting, level, step)
        named = here if named is None else named.union(here)
        if 2 * step <= longest:
            level = written(only_repeated(doubled(level, step)), "line-names")
        step *= 2
    if named is None:
        return windows.limit(0)
    place = F.struct("_doc", "_tag", "first")
    firsts = named.groupBy("name").agg(F.min(place).alias("origin"), F.max(place).alias("last"))
    firsts = firsts.where("origin < last").select("name", "origin")
    return named.join(firsts, "name").where(place > F.col("origin")).select(*KEY, "first", "n")


def line_rows(docs: DataFrame, least_words: int) -> DataFrame:
    """(_doc, _tag, line, name, ahead, behind) per line: its id, and the lines of the shortest runs of enough
    words that start with it and that end with it (0: none)."""
    kind = docs.schema["_doc"].dataType
    schema = pa.schema(
        [("_doc", to_arrow_type(kind)), ("_tag", pa.int64()), ("line", pa.int32()), ("name", pa.binary()), ("ahead", pa.int32()), ("behind", pa.int32())]
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(2)):
                place, line, name, ahead, behind = [], [], [], [], []
                for k, text in enumerate(part.to_pylist()):
                    if text is None:
                        continue
                    rows = text.encode().split(b"\n")
                    more, less = shortest_runs(np.array([len(row.split()) for row in rows], np.int64), least_words)
                    place += [k] * len(rows)
                    line += range(len(rows))
                    name += [hashlib.blake2b(row, digest_size=16).digest() for row in rows]
                    ahead.append(more)
                    behind.append(less)
                if place:
                    columns = [batch.column(c).slice(done, len(part)).take(pa.array(place)) for c in (0, 1)]
                    columns += [pa.array(line, pa.int32()), pa.array(name, pa.binary())]
                    columns += [pa.array(np.concatenate(x).astype(np.int32)) for x in (ahead, behind)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                done += len(part)
        release_memory()

    declared = f"_doc {kind.simpleString()}, _tag bigint, line int, name binary, ahead int, behind int"
    return docs.select(*KEY, "text").mapInArrow(split, declared)


def shortest_runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the lines in the shortest run of ``least`` words from it on, and up to it (0: none)."""
    sums = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    ends = np.searchsorted(sums, sums[:-1] + least)
    begins = np.searchsorted(sums, sums[1:] - least, side="right") - 1
    return np.where(ends <= n, ends - np.arange(n), 0), np.where(begins >= 0, np.arange(n) + 1 - begins, 0)


def only_repeated(names: DataFrame) -> DataFrame:
    """Positions whose name another position has too. Counted by partial aggregates, so a hot name is no hot task."""
    repeated = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    return names.join(repeated, "name", "left_semi")


def doubled(names: DataFrame, step: int) -> DataFrame:
    """Names of runs twice as long, where both halves are named."""
    here = Window.partitionBy(*KEY).orderBy("line")
    second = F.first("name").over(here.rangeBetween(step, step))
    pairs = names.select(*KEY, "line", "name", second.alias("second")).where("second is not null")
    return pairs.select(*KEY, "line", joint_name(F.col("name"), F.col("second")).alias("name"))


def joint_name(*parts: Column) -> Column:
    """Sixteen bytes made of names."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def _window_names(windows: DataFrame, names: DataFrame, step: int) -> DataFrame:
    """Names of runs of ``step`` to ``2 * step - 1`` lines, from their first and their last ``step`` lines."""
    head = names.select(*KEY, F.col("line").alias("first"), F.col("name").alias("head"))
    tail = names.select(*KEY, F.col("line").alias("second"), F.col("name").alias("tail"))
    found = same_place(windows, head, "first", "inner").withColumn("second", F.col("first") + F.col("n") - step)
    found = same_place(found, tail, "second", "inner")
    name = joint_name(F.col("head"), F.col("tail"), F.encode(F.col("n").cast("string"), "UTF-8"))
    return found.select(*KEY, "first", "n", name.alias("name"))


def same_place(left: DataFrame, right: DataFrame, line: str, how: str) -> DataFrame:
    """Join on document and line; a NULL identifier equals itself."""
    renamed = right.withColumnsRenamed({"_doc": "_doc2", "_tag": "_tag2", line: "_line2"})
    on = left["_doc"].eqNullSafe(renamed["_doc2"]) & (left["_tag"] == renamed["_tag2"]) & (left[line] == renamed["_line2"])
    return left.join(renamed, on, how).drop("_doc2", "_tag2", "_line2")


def _without_runs(texts: pa.Array, cuts: pa.Array) -> pa.Array:
    rows = []
    for text, ranges in zip(texts, cuts):
        text, ranges = text.as_py(), ranges.as_py()
        lines = [] if text is None else text.split("\n")
        gone = np.zeros(len(lines) + 2, np.int8)
        for cut in ranges or ():
            gone[cut["first"] + 1 : cut["first"] + cut["n"] + 1] = 1
        if ranges:
            text = "\n".join(line for line, out in zip(lines, gone[1:]) if not out)
        rows.append({"text": text, "n_lines": len(lines), "n_removed": int(gone.sum()), "n_runs": int((np.diff(gone) > 0).sum())})
    return pa.array(rows, REMOVED_ARROW)
