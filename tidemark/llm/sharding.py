"""Sharding by histogram sort, with built-in functions only.

Rows have an order key, and shards are ranges of it that hold near equal bytes. The cuts between
shards are found by counting: each round counts the exact bytes and rows below candidate keys, for
the ranges of keys that still hold a cut, and splits those ranges further, until each cut is as near
to its aim as asked. Only then do the rows move, once.

The order key of a row is a hash of its identifier, so that each shard is a random mixture, followed
by its place in the input, so that no two rows share a key and no run of repeated rows is beyond
splitting. Keys are texts of 32 hexadecimal digits; a candidate key is a prefix.

What a round brings to the driver is bounded by the number of shards (256 counts for each cut), not by the data.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.arrays import without
from tidemark.session import written

KEY_DIGITS = 32
ROUND_DIGITS = 2


@dataclass
class _Cut:
    """A cut between two shards: somewhere in the keys that begin with ``prefix``."""

    aim: int
    prefix: str = ""
    below: int = 0  # bytes below the prefix
    key: str | None = None  # the first key above the cut, once found
    counts: list[tuple[str, int, int]] = field(default_factory=list)


def shard_by_bytes(
    df: DataFrame,
    n_shards: int,
    id: str = "doc_id",
    text: str = "text",
    tolerance: float = 0.001,
    block_bytes: int = 64 << 20,
) -> DataFrame:
    """Add ``size`` (UTF-8 bytes of the text plus 1), ``shard`` and ``slot`` to each row.

    Shards hold near equal sums of ``size``: each cut between them is off its aim by at most
    ``tolerance`` of a shard, or by half a row if that is more. Slots count from 0 without gaps
    within a shard, in the order of keys. All columns of ``df`` travel with their rows; a task holds
    a block of about ``block_bytes``, many to a shard.

    The input is read twice and must come in the same order both times, as a table does.

    Edge cases: a NULL text has size 1, as an empty one. Rows with equal or NULL identifiers, and
    repeated rows, are told apart by their place and spread as others are. A text larger than a
    shard fills one alone. With fewer rows than shards some shards stay empty; an empty table stays
    empty. Input columns named as an added one are replaced.
    """
    kept = without(df, "size", "shard", "slot", "_key", "_block", "_offset")
    columns = [F.col(f"`{c}`") for c in kept.columns]
    place = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    key = F.concat(F.lpad(F.hex(F.xxhash64(F.col(id))), 16, "0"), place)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    keyed = kept.select(*columns, size.alias("size"), key.alias("_key"))

    keys = written(keyed.select("_key", "size"), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cuts = find_cuts(keys, total, n_shards, tolerance)

    digits = 1
    while 16**digits < total / block_bytes:
        digits += 1
    block = F.substring("_key", 1, digits)
    offsets = in_shards(keys, cuts).groupBy("shard", block.alias("_block")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("shard", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))

    placed = in_shards(keyed, cuts).withColumn("_block", block)
    rank = F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_key"))
    ranked = placed.withColumn("_rank", rank).join(offsets, ["shard", "_block"])
    return ranked.select(*columns, "size", "shard", (F.col("_offset") + F.col("_rank") - 1).alias("slot"))


def find_cuts(keys: DataFrame, total: int, n_shards: int, tolerance: float) -> list[str]:
    """First keys of shards 1, 2, ...: prefixes, such that keys below sum up to near equal sizes."""
    cuts = [_Cut(total * k // n_shards) for k in range(1, n_shards)]
    slack = tolerance * total / n_shards
    while open_cuts := [cut for cut in cuts if cut.key is None]:
        depth = len(open_cuts[0].prefix)
        counts = _count_below(keys, {cut.prefix for cut in open_cuts}, depth)
        for cut in open_cuts:
            _narrow(cut, counts.get(cut.prefix, []), slack)
    return sorted(cut.key for cut in cuts)


def _count_below(keys: DataFrame, prefixes: set[str], depth: int) -> dict[str, list[tuple[str, int, int]]]:
    """For each open prefix: its longer prefixes in order, with their bytes and rows."""
    longer = F.substring("_key", 1, depth + ROUND_DIGITS)
    if depth:
        wanted = small_table(keys, "_prefix string", [{"_prefix": p} for p in sorted(prefixes)])
        keys = keys.join(F.broadcast(wanted), F.substring("_key", 1, depth) == F.col("_prefix"), "left_semi")
    rows = keys.groupBy(longer.alias("p")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    counts: dict[str, list[tuple[str, int, int]]] = {}
    for row in sorted(rows):
        counts.setdefault(row.p[:depth], []).append(tuple(row))
    return counts


def _narrow(cut: _Cut, counts: list[tuple[str, int, int]], slack: float) -> None:
    """Go to the longer prefix that holds the aim, or settle for one of its ends."""
    below = cut.below
    for prefix, size, rows in counts:
        if below + size >= cut.aim:
            low, high = cut.aim - below, below + size - cut.aim
            if min(low, high) <= slack or rows == 1 or len(prefix) == KEY_DIGITS:
                cut.key = prefix if low <= high else prefix + "~"  # "~" is above all digits
            cut.prefix, cut.below = prefix, below
            return
        below += size
    cut.key = cut.prefix + "~"


def in_shards(df: DataFrame, cuts: list[str]) -> DataFrame:
    """Add ``shard``: the number of cuts at or below ``_key``.

    The cuts lie in a small table by the first digits of the key: each row meets its own entry only,
    which has the shard of its lowest key and the few cuts inside it.
    """
    prefixes = [f"{n:0{ROUND_DIGITS}X}" for n in range(16**ROUND_DIGITS)]
    entries = [
        {"_prefix": p, "_first": sum(c <= p for c in cuts), "_cuts": [c for c in cuts if c > p and c[:ROUND_DIGITS] == p]} for p in prefixes
    ]
    table = F.broadcast(small_table(df, "_prefix string, _first int, _cuts array<string>", entries))
    shard = F.col("_first") + F.size(F.filter("_cuts", lambda c: c <= F.col("_key")))
    joined = df.join(table, F.substring("_key", 1, ROUND_DIGITS) == F.col("_prefix"))
    return joined.withColumn("shard", shard).drop("_prefix", "_first", "_cuts")


def small_table(df: DataFrame, schema: str, rows: list[dict]) -> DataFrame:
    """A table of a few rows that the plan itself carries."""
    fields = ", ".join(part.strip().replace(" ", ": ", 1) for part in schema.split(", "))
    literal = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")
    return df.sparkSession.range(1).select(F.inline(literal))


def text_crc32(text: str | Column) -> Column:
    """Unsigned CRC-32 of the text's UTF-8 bytes; of no bytes for NULL."""
    return F.crc32(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"))
