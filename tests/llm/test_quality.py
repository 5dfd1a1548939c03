"""Counts and verdicts against plain loops."""

import random
from collections import Counter

import zstandard
from llm_paths import DATA

from tidemark.llm.quality import CompressionBands, score_quality
from tidemark.llm.queries import QUERIES

BLANKS = b" \t\n\x0b\x0c\r"


def brute(text, bands=CompressionBands()):
    raw = (text or "").encode()
    words = raw.split()
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    lines = [line for line in raw.split(b"\n") if line.strip(BLANKS)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    squeeze = zstandard.ZstdCompressor(level=bands.level).compress
    kept = not failed
    if raw:
        ratio = len(squeeze(raw)) / len(raw)
        low, high = next((low, high) for size, low, high in bands.whole if len(raw) < size)
        kept &= low <= ratio <= high
        if len(raw) >= 2 * bands.chunk_bytes:
            starts = list(range(0, len(raw) - bands.chunk_bytes + 1, bands.chunk_bytes))
            chunks = [raw[a:b] for a, b in zip(starts, starts[1:] + [len(raw)])]
            bad = sum(not bands.chunk_least <= len(squeeze(c)) / len(c) <= bands.chunk_greatest for c in chunks)
            kept &= bad <= bands.bad_share * len(chunks)
    word_chars = sum(len(w.decode()) for w in words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), len(covered), failed, kept


def shown(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed, row.kept


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op3_quality_rules"](spark, DATA).collect()
    assert len(rows) == len(texts)
    assert [r.doc_id for r in rows if shown(r) != brute(texts[r.doc_id])] == []
    assert 0 < sum(r.kept for r in rows) < len(rows)


def test_repetition_and_noise_are_rejected(spark):
    draw = random.Random(3)
    prose = " ".join("".join(draw.choices("etaoinshr", k=draw.randint(2, 9))) for _ in range(900))
    noise = " ".join("".join(chr(draw.randint(0x4E00, 0x9000)) for _ in range(30)) for _ in range(60))
    half = prose + " " + " ".join(f"{i % 7}row" for i in range(2000))
    texts = [prose, noise, half, "word " * 500]
    rows = score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True, False, False, False]
    assert [r.base_failed for r in rows][:2] == [False, False]


def test_edges(spark):
    long = "one two three four five six\n" * 200_000
    texts = [None, "", " \t\n\x0b\x0c\r ", "a b c d e a b c d e", "x y " * 3, "l\nl\n\nl", long, "l\nl\n\nl"]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "id long, text string, Kept boolean")
    scored = score_quality(df)
    assert scored.columns.count("kept") == 1 and "Kept" not in scored.columns
    rows = {r.id: shown(r) for r in scored.collect()}
    assert rows == {i: brute(t) for i, t in enumerate(texts)}
    assert score_quality(df.limit(0)).count() == 0
    assert score_quality(df.withColumn("text", df.text.cast("string")).where("text is null")).collect()[0].kept is False
