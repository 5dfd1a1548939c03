"""Phrase counts and scores against plain counting and SQL, and odd inputs."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from against_sql import differences_to_sql
from llm_paths import DATA

from tidemark.llm import collocations, queries
from tidemark.llm.arrays import Words
from tidemark.llm.collocations import TEXT, chunk_begins, mine_collocations


def plain_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = {(lang, w[i:j], a) for (lang, w), a in candidates.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w)}
    out = []
    for (lang, words), a in candidates.items():
        if (lang, words, a) in inside:
            continue
        cuts = [(f[lang, words[:k]], f[lang, words[k:]], k) for k in range(1, len(words))]
        score, _, left, right = min((1000 * a * n[lang] // (x * y), k, x, y) for x, y, k in cuts)
        out.append((lang, " ".join(words), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(ranked)


def invented(n, seed):
    rng = random.Random(seed)
    shared = ["in The end", "new york city, new york", "é À ß", "a a a a a a a", "x"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(shared + [" ".join(rng.choices("abcdefg", k=rng.randint(1, 7)))]) for _ in range(rng.randint(0, 12))]
        rows.append((rng.choice(["en", "de", None]), rng.choice([" ", ", ", "\t\t", "\n", "\x0b"]).join(parts)))
    return rows + [("en", None), ("fr", ""), ("fr", " . ,"), (None, "a b " * 200)]


@pytest.mark.parametrize("least,top", [(3, 10**6), (20, 5)])
def test_equals_plain_counting(spark, monkeypatch, least, top):
    """With short and long chunks, the numbers are those of plain counting."""
    rows = invented(80, least)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(map(tuple, mine_collocations(docs, least, top).collect()))
    assert got == plain_collocations(rows, least, top)


def test_copies_are_counted_each(spark):
    rows = [("en", "one two three four five six. " * 3)] * 40
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert collocations.parsed(docs).count() <= 4
    assert sorted(map(tuple, mine_collocations(docs, 100, 50).collect())) == plain_collocations(rows, 100, 50)


def test_a_full_bitmap_costs_no_phrase(spark, monkeypatch):
    rows = invented(60, 9)
    dictionary = collocations.parsed(spark.createDataFrame(rows, "lang string, text string").fillna("und", ["lang"]))
    full = collocations.frequent_pairs(dictionary, 5)
    counts = {(r.lang, r.phrase): r.f for r in collocations.phrase_counts(dictionary, full).where("f >= 5").collect()}
    every = {(r.lang, r.phrase): r.f for r in collocations.phrase_counts(dictionary, ~(full & ~full)).where("f >= 5").collect()}
    assert counts == every


def test_long_texts_are_cut_at_triggers_and_in_the_end_anywhere():
    assert len(chunk_begins(Words(pa.array(["same " * 20_000]), TEXT))) in (5, 20_000 - 1, 20_000)
    rng = random.Random(1)
    many = " ".join(str(rng.randrange(1000)) for _ in range(50_000))
    begins = chunk_begins(Words(pa.array([many, "", many]), TEXT))
    assert 1000 < len(begins) < 2500 and len(set(begins.tolist())) == len(begins) and begins.tolist() == sorted(begins.tolist())
    half = len(begins) // 2
    assert (begins[half:] - 50_000 == begins[:half]).all()  # equal texts, equal chunks


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert mine_collocations(empty).collect() == []
    rows = [("x", "a b", "y", 1, 2)] * 3
    clash = spark.createDataFrame(rows, "lang string, text string, chunk string, n int, own int")
    assert [tuple(r) for r in mine_collocations(clash, 3).collect()] == [("x", 1, "a b", 3, 3, 3, 6, 2000)]


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**11
    counts = spark.createDataFrame([("e", "a b", 2, big), ("e", "a", 1, big), ("e", "b", 1, big + 1)], "lang string, phrase string, words int, f bigint")
    totals = spark.createDataFrame([("e", 7 * 10**12)], "lang string, n bigint")
    row = collocations.best_phrases(counts, totals, 10).first()
    assert row.score == 1000 * big * 7 * 10**12 // (big * (big + 1))


def test_query_equals_sql(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    assert differences_to_sql(mine_collocations(rows, 3, 500), queries.collocation_sql(3, 500), DATA) == []
    assert differences_to_sql(queries.QUERIES["op11_collocations"](spark, DATA), queries.SQL["op11_collocations"], DATA) == []
