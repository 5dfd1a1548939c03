"""Archives written and read back, against SQL and against the payloads themselves."""

import glob
import gzip
import hashlib

import pytest
from against_sql import differences_to_sql
from llm_paths import DATA
from pyspark.sql import functions as F

from tidemark.llm.queries import QUERIES, SQL
from tidemark.llm.warc import checked_payloads, chunk_table, read_archives, write_archives
from tidemark.session import new_table_path


def test_query_equals_sql(spark):
    assert differences_to_sql(QUERIES["op8_warc_archive"](spark, DATA), SQL["op8_warc_archive"], DATA) == []


def test_round_trip_in_segments(spark):
    payloads = ["é" * 250, "a\r\n\r\nb" * 90, "", None, "short", "short", "WARC/1.1\r\n" * 30, "é" * 250, "x" * 100, "x" * 100, "é" * 250]
    rows = [(i, f"http://h/{i}\r\nx", p, i) for i, p in enumerate(payloads)] + [(10, None, payloads[10], 0), (None, None, "n" * 300, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, Row int")
    path = new_table_path(spark, "warc")
    write_archives(pages, path, chunk_bytes=64, records_per_file=5)
    records = read_archives(spark, path)
    got = sorted((tuple(r)[:1] + tuple(r)[2:] for r in checked_payloads(records).collect()), key=repr)
    want = []
    for i, _, payload, _ in rows:
        raw = (payload or "").encode()
        first = min((r[0] for r in rows if r[0] is not None and r[2] == payload), default=None) if len(raw) >= 100 else None
        refers = first if first is not None and i is not None and i > first else None
        want.append((str(i) if i is not None else "null", "revisit" if refers is not None else "response", len(raw), hashlib.sha256(raw).hexdigest(), str(refers) if refers is not None else None))
    assert got == sorted(want, key=repr)
    bodies = records.groupBy("page", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "block"))), lambda s: s.block), "").alias("b"))
    by_page = {r.page: r.b for r in bodies.collect()}
    assert by_page["0"] == payloads[0] and by_page["1"] == payloads[1] and by_page["6"] == payloads[6] and by_page["7"] == ""
    assert records.agg(F.max(F.octet_length("block"))).first()[0] <= 64


def test_chunks_carry_digests(spark):
    rows = chunk_table(spark.createDataFrame([(1, "añb" * 20), (2, None)], "id long, t string"), "id", "t", 7).orderBy("id", "chunk_no").collect()
    text = ""
    for row in rows[:-1]:
        assert row.chunk_start == len(text.encode()) and len(row.chunk.encode()) <= 7
        text += row.chunk
        assert row.digest_so_far == hashlib.sha256(text.encode()).hexdigest()
    assert text == "añb" * 20 and rows[0].n_chunks == len(rows) - 1
    assert (rows[-1].id, rows[-1].chunk, rows[-1].n_chunks) == (2, "", 1)


def test_damage_is_noticed(spark):
    path = new_table_path(spark, "warc")
    write_archives(spark.createDataFrame([(1, "u", "abc" * 100)], "page_id long, url string, html string"), path, chunk_bytes=128)
    name = glob.glob(f"{path}/*.gz")[0]
    content = gzip.decompress(open(name, "rb").read())
    assert content.count(b"WARC/1.1") == 3 and content.endswith(b"\r\n\r\n")
    worse = new_table_path(spark, "warc")
    spark.createDataFrame([(content.decode().replace("cab", "cba"),)], "value string").coalesce(1).write.option("lineSep", "\r\n").option("compression", "gzip").text(worse)
    with pytest.raises(Exception, match="damaged"):
        checked_payloads(read_archives(spark, worse)).collect()


def test_empty_table(spark):
    path = new_table_path(spark, "warc")
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert checked_payloads(read_archives(spark, path)).count() == 0
