"""Held-out accuracy of the toxicity score, its features, and odd inputs."""

import random
import zlib

import pyarrow as pa
import pytest
from llm_paths import DATA
from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.toxicity import FEATURES, features_of, labelled_rows, learn_lexicon, learn_toxicity, score_toxicity

LARGER = DATA.replace("sf0.001", "sf0.01")


def invented(n, seed=1):
    """Texts of made-up words; every fourth has words that begin with ``grum``."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices("abcdeilnorst", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 40))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = "grum" + "".join(rng.choices("aeilnrst", k=3))
        rows.append((i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = invented(600)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    return docs, labels, learn_toxicity(docs, labels)


def test_words_of_one_family_are_learned(spark, trained):
    _, _, model = trained
    assert model.lexicon["^grum"] > 1
    rows = [(1, "grumpel you"), (2, "plain words only"), (3, "calm " * 20 + "grumorious"), (4, ""), (5, None), (6, "xx " * 1_500_000 + "grumble")]
    fresh = spark.createDataFrame(rows, "doc_id bigint, text string")
    score = {r.doc_id: r.score for r in score_toxicity(fresh, model).collect()}
    assert score[1] > 0.5 and score[3] > 0.5 and max(score[2], score[4], score[5]) < 0.5
    assert score[4] == score[5] and all(0 <= s <= 1 for s in score.values())


def test_repeated_rows_and_clashing_columns(spark, trained):
    model = trained[2]
    rows = [(None, "grumpel", "a", 1.0, 2), (None, "grumpel", "b", 1.0, 2), (7, "calm", "c", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, score string, features double, _features int")
    got = score_toxicity(docs, model)
    assert got.columns == ["doc_id", "score"]
    found = sorted((r.doc_id or "", r.score) for r in got.collect())
    assert found[0] == found[1] and found[0][1] > 0.5 > found[2][1]


def test_empty_tables_and_single_classes(spark, trained):
    docs, labels, model = trained
    assert score_toxicity(docs.limit(0), model).collect() == []
    none = learn_toxicity(docs, labels.limit(0))
    assert {r.score for r in score_toxicity(docs, none).collect()} == {0.0}
    ones = learn_toxicity(docs, labels.withColumn("toxic", F.lit(1)))
    assert {r.score for r in score_toxicity(docs, ones).collect()} == {1.0}


def test_few_labels_serve_all_three_steps(spark, trained):
    docs, labels, _ = trained
    few = learn_toxicity(docs, labels.where("doc_id < 12"))
    assert few.trees is not None
    assert score_toxicity(docs, few).count() == 600


def test_labels_are_bounded_and_cleaned(spark, trained):
    docs, labels, _ = trained
    assert labelled_rows(docs, labels, 50).count() == 50
    odd = labels.where("doc_id < 2").union(spark.createDataFrame([(1, 1), (1, None), (None, 1), (9999, 1)], labels.schema))
    assert sorted(r.toxic for r in labelled_rows(docs, odd).collect()) == [1, 1]


def test_lexicon_counts_texts_not_words(spark):
    rows = [("zorb " * 50, 1)] + [("zelt", 1)] * 3 + [("calm day", 0)] * 20
    found = learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert "=zelt" in found and "=zorb" not in found


def test_features():
    row = features_of(pa.array(["YOU are a scum!!", "st*pid sooo why?", None]), {"=scum": 2.0, "=stpid": 3.0})
    first, second, third = (dict(zip(FEATURES, values.tolist())) for values in row)
    assert first["word_strongest"] == 2.0 and first["word_density"] == 0.5 and first["near_second_person"] == 1.0
    assert first["words_in_capitals"] == 0.25 and first["exclamations"] == 0.5 and first["capitals"] == 3 / 11
    assert second["hidden_words"] == 1 / 3 and second["hidden_density"] == 1.0 and second["drawn_out"] == 1 / 3 and second["questions"] == 1 / 3
    assert set(third.values()) == {0.0}


def test_held_out_documents(spark):
    """Learned from four fifths of the labels, the score ranks the others nearly always right."""
    rows = queries.QUERIES["op13_toxicity"](spark, LARGER)
    assert rows.count() == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    labels = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "toxic")
    judged = [r for r in rows.join(labels, "doc_id").collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in judged)
    toxic, clean = ([r for r in judged if r.toxic == value] for value in (1, 0))
    ranked = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in clean)
    assert ranked / (len(toxic) * len(clean)) > 0.95
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
