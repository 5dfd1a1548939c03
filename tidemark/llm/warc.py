"""WARC archives by way of a table of record chunks.

A payload travels as rows of (record identifier, chunk number, chunk): no row, buffer or file part
ever holds more than ``chunk_bytes`` of it. Each chunk carries the digest of the payload up to its
own end, so the last one has the digest of the whole, and whoever reads the chunks in order can check
each as it comes. In the archive each chunk is a record of its own, by the format's segmentation: the
first is the ``response``, the others are ``continuation`` records with segment numbers. Payloads
that equal an earlier one are ``revisit`` records without a body.

Archives are written by Spark's text writer, whose line separator is the blank line that ends a
record, and so can be on any storage that Spark reaches. A record with ``Content-Length`` is read by
that length, never by searching for separators.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n\r\n"
CHUNKS = "chunk_no long, n_chunks long, chunk_start long, chunk string, digest_so_far string"
READ = (
    "page string, row long, record_type string, segment long, n_segments long, segment_start long, payload_bytes long, "
    "payload_digest string, refers_to string, uri string, block string, digest_so_far string"
)
#: Text handed from a task to Spark at once.
BATCH_BYTES = 4 << 20


def payload_digest(payload: str, step: int = 1 << 16) -> Column:
    """Struct of size and SHA-256 of a payload's UTF-8 bytes, hashed piece by piece. NULL is empty."""

    @F.arrow_udf("struct<payload_bytes: bigint, payload_digest: string>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sizes, digests = [], []
            for view in _views(texts):
                state = hashlib.sha256()
                for start in range(0, len(view), step):
                    state.update(view[start : start + step])
                sizes.append(len(view))
                digests.append(state.hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["payload_bytes", "payload_digest"]
            )

    return digest(F.col(payload))


def revisits(pages: DataFrame, id: str = "page_id", payload: str = "html", least_bytes: int = 100) -> DataFrame:
    """(id, payload_digest, refers_to) of the pages whose payload an earlier page has.

    Only sizes and digests are shuffled. The first of each digest is found by partial aggregates, so
    a payload that a third of all pages share puts no group into one task; the join back is one that
    Spark splits when a digest is hot.
    """
    large = pages.select(F.col(id).alias("id"), payload_digest(payload).alias("d")).select("id", "d.*")
    large = large.where(F.col("payload_bytes") >= least_bytes).select("id", "payload_digest")
    first = large.groupBy("payload_digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("last"))
    first = first.where("last > refers_to").drop("last")
    return large.join(first, "payload_digest").where("id > refers_to").distinct()


def chunk_table(records: DataFrame, id: str, payload: str, chunk_bytes: int = 1 << 16, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, kept columns, ``CHUNKS``) for each payload; an empty or NULL payload has one empty chunk.

    A chunk ends at a whole character, so it may be up to three bytes shorter than ``chunk_bytes``.
    """
    columns = [id, *keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*columns).schema) + ", " + CHUNKS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chunks, held = [], [], 0
            for place, view in enumerate(_views(batch.column(len(columns)))):
                state, cuts = hashlib.sha256(), list(_cuts(view, chunk_bytes))
                for number, (start, end) in enumerate(cuts):
                    state.update(view[start:end])
                    rows.append(place)
                    chunks.append((number, len(cuts), start, str(view[start:end], "utf-8"), state.hexdigest()))
                    held += end - start + 100
                    if held >= BATCH_BYTES:
                        yield _chunk_batch(batch, columns, rows, chunks)
                        rows, chunks, held = [], [], 0
            if rows:
                yield _chunk_batch(batch, columns, rows, chunks)

    return records.select(*columns, F.col(payload)).mapInArrow(cut, schema)


def _chunk_batch(batch: pa.RecordBatch, columns: list[str], rows: list[int], chunks: list[tuple]) -> pa.RecordBatch:
    taken = batch.select(list(range(len(columns)))).take(pa.array(rows))
    number, n, start, text, digest = zip(*chunks)
    added = [pa.array(number, pa.int64()), pa.array(n, pa.int64()), pa.array(start, pa.int64()), pa.array(text), pa.array(digest)]
    names = [part.split()[0] for part in CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([*taken.columns, *added], names=[*columns, *names])


def _views(texts: pa.Array) -> Iterator[memoryview]:
    """The bytes of each text, in place; NULL is empty."""
    for text in texts.cast(pa.binary()):
        buffer = text.as_buffer() if text.is_valid else None
        yield memoryview(buffer) if buffer is not None and buffer.size else memoryview(b"")


def _cuts(view: memoryview, size: int) -> Iterator[tuple[int, int]]:
    start = 0
    while True:
        end = min(start + size, len(view))
        while end < len(view) and end > start + 1 and view[end] & 0xC0 == 0x80:
            end -= 1
        yield start, end
        start = end
        if start >= len(view):
            return


def write_archives(
    pages: DataFrame,
    path: str,
    id: str = "page_id",
    payload: str = "html",
    uri: str = "url",
    least_bytes: int = 100,
    chunk_bytes: int = 1 << 16,
    records_per_file: int = 256,
) -> None:
    """Write one WARC record per page (more, in segments, for a payload over ``chunk_bytes``) under ``path``.

    Of pages with equal payloads of at least ``least_bytes``, the one with the smallest id is the
    response and the others revisit it. Files are compressed, and hold at most ``records_per_file``
    records and so a bounded number of bytes.

    Edge cases: a NULL payload is an empty one; a NULL address is written as an empty one; a NULL
    identifier is written as the word null. Equal ids and repeated rows keep a record each. An empty table makes an
    archive without records. Other columns are ignored.
    """
    bodies = pages.select(
        F.col(id).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(uri).cast("string"), F.lit("")).alias("uri"),
        F.col(payload).alias("payload"),
        payload_digest(payload).alias("d"),
    ).select("id", "row", "uri", "payload", "d.*")
    records = bodies.join(revisits(pages, id, payload, least_bytes), ["id", "payload_digest"], "left")
    records = records.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    kept = ("row", "uri", "payload_bytes", "payload_digest", "refers_to")
    chunks = chunk_table(records, "id", "payload", chunk_bytes, kept)
    name = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("row"))
    first, revisit = F.col("chunk_no") == 0, F.col("refers_to").isNotNull()
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").when(first, "response").otherwise("continuation")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.when(first, "").otherwise(F.concat(F.lit(":segment:"), F.col("chunk_no") + 1)), F.lit(">")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.when(first, F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("uri", r"[\r\n]", ""))),
        F.when(first, F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"))),
        F.when(first, F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("n_chunks") > 1, F.concat(F.lit("WARC-Segment-Number: "), F.col("chunk_no") + 1)),
        F.when(~first, F.concat(F.lit("WARC-Segment-Origin-ID: <urn:page:"), name, F.lit(">"))),
        F.when(F.col("n_chunks") > 1, F.concat(F.lit("X-Segment-Start: "), F.col("chunk_start"))),
        F.when(F.col("n_chunks") > 1, F.concat(F.lit("X-Segments: "), F.col("n_chunks"))),
        F.concat(F.lit("X-Digest-So-Far: sha256:"), F.col("digest_so_far")),
        F.concat(F.lit("Content-Length: "), F.octet_length("chunk")),
    ]
    record = F.concat(F.array_join(F.array(*head), "\r\n"), F.lit(END), F.col("chunk"))
    chunks.select(record).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


_READ_NAMES = [part.split()[0] for part in READ.split(", ")]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``, one row (``READ``) per segment.

    A file is inflated and parsed piece by piece. Every segment's bytes are hashed: the first segment's
    digest must be the one it carries (later ones are checked by ``checked_payloads``).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in _records(memoryview(content.as_buffer())):
                    rows.append(_row(head, block))
                    held += len(block) + 500
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ_ARROW)

    return files.mapInArrow(parse, READ)


def checked_payloads(records: DataFrame) -> DataFrame:
    """Read-back records, one row each: (page, row, record_type, payload_bytes, payload_digest, refers_to).

    Payloads in one segment were hashed as they were read. Those in several are hashed again in the
    order of their segments, one segment in memory at a time. A digest that differs from the one in
    the header, or a missing byte, ends the run.
    """
    key = ["page", "row", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    whole = records.where("n_segments = 1").select(*key)
    parts = records.where("n_segments > 1")
    ordered = parts.repartition("page", "row").sortWithinPartitions("page", "row", "segment")
    columns = [*key, "segment", "n_segments", "segment_start", "digest_so_far", "block"]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, size, first = None, None, 0, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                name = row["page"], row["row"]
                if row["segment"] == 1:
                    now, state, size, first = name, hashlib.sha256(), 0, row
                block = row["block"].encode()
                if name != now or row["segment_start"] != size:
                    raise ValueError(f"record {name}: a segment is missing before number {row['segment']}")
                state.update(block)
                size += len(block)
                if state.hexdigest() != row["digest_so_far"]:
                    raise ValueError(f"record {now}: segment {row['segment']} is damaged")
                if row["segment"] == row["n_segments"]:
                    if size != first["payload_bytes"] or state.hexdigest() != first["payload_digest"]:
                        raise ValueError(f"record {now} is damaged")
                    done.append({name: first[name] for name in key})
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=pa.schema([_READ_ARROW.field(name) for name in key]))

    schema = ", ".join(part for part in READ.split(", ") if part.split()[0] in key)
    return whole.unionByName(ordered.select(*columns).mapInArrow(follow, schema))


def _records(packed: memoryview, step: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one compressed archive, with one record in memory at a time."""
    inflate, held, at = zlib.decompressobj(31), bytearray(), 0

    def more() -> bool:
        nonlocal at, inflate
        if at >= len(packed):
            return False
        held.extend(inflate.decompress(packed[at : at + step]))
        at += step
        while inflate.eof and inflate.unused_data:  # the next member of the same file
            rest, inflate = inflate.unused_data, zlib.decompressobj(31)
            held.extend(inflate.decompress(rest))
        return True

    def upto(n: int) -> bytes:
        while len(held) < n and more():
            pass
        if len(held) < n:
            raise ValueError("the archive ends inside a record")
        piece = bytes(held[:n])
        del held[:n]
        return piece

    while held or more():
        if not held:
            continue
        while (end := held.find(END.encode())) < 0:
            if not more():
                raise ValueError("the archive ends inside a header")
        lines = upto(end + 4)[:-4].decode().split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        block = upto(int(head["Content-Length"]))
        if not lines[0].startswith("WARC/") or upto(4) != END.encode():
            raise ValueError("not a record")
        yield head, block


def _row(head: dict[str, str], block: bytes) -> dict:
    plain = lambda name: re.fullmatch("<urn:page:(.*)>", head[name])[1] if name in head else None
    digest = lambda name: head[name].removeprefix("sha256:") if name in head else None
    kind, segment = head["WARC-Type"], int(head.get("WARC-Segment-Number", 1))
    if segment == 1 and hashlib.sha256(block).hexdigest() != digest("X-Digest-So-Far"):
        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    row = dict.fromkeys(_READ_NAMES) | {"record_type": "response" if kind == "continuation" else kind, "segment": segment}
    page, _, number = (plain("WARC-Segment-Origin-ID") or plain("WARC-Record-ID")).rpartition(":")
    row |= {"page": page, "row": int(number), "n_segments": int(head.get("X-Segments", 1))}
    row |= {"segment_start": int(head.get("X-Segment-Start", 0)), "digest_so_far": digest("X-Digest-So-Far"), "block": block.decode()}
    if segment == 1:
        row |= {"payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest("WARC-Payload-Digest")}
        row |= {"refers_to": plain("WARC-Refers-To"), "uri": head.get("WARC-Target-URI", "")}
        if kind == "response" and row["n_segments"] == 1 and (len(block), row["digest_so_far"]) != (row["payload_bytes"], row["payload_digest"]):
            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
    return row


_READ_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64()}[k]) for n, k in (part.split() for part in READ.split(", "))])
