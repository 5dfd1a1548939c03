"""Packed token files: matrices of ids with cumulative segment lengths and position resets.

A file is a Parquet table with one row per sequence: ``window`` little-endian unsigned 32-bit ids,
padded at the end; ``cu_seqlens``, which begins with 0 and ends with the tokens used; as many
little-endian positions, which restart at 0 with each segment and are 0 in the padding; and, per
segment, the document and where in it the segment starts. Documents longer than a window are split
over several sequences and lose nothing.

Ids are shuffled once, to the group that packs them; a group is bounded as in ``packing``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.arrays import without
from tidemark.llm.packing import GROUP_TOKENS, best_fit_decreasing, group_count, sequence_ids, token_pieces, with_group
from tidemark.llm.tokens import id_bytes


def packed_sequences(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    pad_id: int = 0,
    window: int = 4096,
    id: str = "doc_id",
    text: str = "text",
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per sequence: (sequence_id, ids, cu_seqlens, positions, segment_docs, segment_starts).

    Edge cases: a NULL or empty text is a segment of the end id alone. Repeated rows and equal or
    NULL identifiers are packed row by row. An empty table has no sequences. Other columns are ignored.
    """
    docs = without(docs.select(id, text), "_group")
    kind = docs.schema[id].dataType
    width = 2 if max(end_id, pad_id) < 1 << 16 and id_bytes(tokenizer) == 2 else 4  # in the shuffle; files have four
    pieces = token_pieces(docs, tokenizer, end_id, window, id, text, with_ids=True, id_bytes=width)
    pieces = with_group(pieces, group_count(docs, text, group_tokens), id).select(F.col(id).alias("doc"), "start", "length", "ids", "_group")
    schema = (
        "sequence_id bigint, ids binary, cu_seqlens array<int>, positions binary, "
        f"segment_docs array<{kind.simpleString()}>, segment_starts array<bigint>"
    )
    made = pa.schema(
        [
            ("sequence_id", pa.int64()),
            ("ids", pa.binary()),
            ("cu_seqlens", pa.list_(pa.int32())),
            ("positions", pa.binary()),
            ("segment_docs", pa.list_(to_arrow_type(kind))),
            ("segment_starts", pa.list_(pa.int64())),
        ]
    )

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        lengths = table.column("length").to_numpy()
        windows, offsets = best_fit_decreasing(lengths, window)
        order = np.lexsort([offsets, windows])
        taken = table.take(pa.array(order))
        docs_in, starts, raw = (taken.column(name).to_pylist() for name in ("doc", "start", "ids"))
        rows, cuts = [], [*np.flatnonzero(offsets[order] == 0).tolist(), len(order)]
        for begin, end in zip(cuts, cuts[1:]):
            ends = np.cumsum(lengths[order[begin:end]])
            used = int(ends[-1])
            positions = np.zeros(window, "<u4")
            positions[:used] = np.arange(used) - np.repeat(offsets[order[begin:end]], lengths[order[begin:end]])
            rows.append(
                {
                    "sequence_id": int(sequence_ids(key[0].as_py(), windows[order[begin]])),
                    "ids": np.frombuffer(b"".join(raw[begin:end]), f"<u{width}").astype("<u4").tobytes() + np.full(window - used, pad_id, "<u4").tobytes(),
                    "cu_seqlens": [0, *ends.tolist()],
                    "positions": positions.tobytes(),
                    "segment_docs": docs_in[begin:end],
                    "segment_starts": starts[begin:end],
                }
            )
        return pa.Table.from_pylist(rows, schema=made)

    return pieces.groupBy("_group").applyInArrow(pack, schema)


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int, **options) -> None:
    """Write the packed sequences of all documents under ``path`` (options as in ``packed_sequences``)."""
    packed_sequences(docs, tokenizer, end_id, **options).write.option("compression", "zstd").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Packed sequences, with ``n_tokens`` and ``n_segments`` from the cumulative lengths."""
    rows = spark.read.parquet(path)
    return rows.withColumns({"n_tokens": F.element_at("cu_seqlens", -1).cast("bigint"), "n_segments": (F.size("cu_seqlens") - 1).cast("bigint")})
