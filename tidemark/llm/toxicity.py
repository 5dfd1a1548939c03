"""Toxicity of texts: gradient-boosted trees over a few dense features, with isotonic calibration.

Three disjoint parts of the labelled rows teach three things in turn, so that none is fooled by the one before. The first gives
a lexicon: words, and beginnings of words, that toxic texts hold far more often than others. The second grows the trees, over
how dense, strong and many the lexicon's words are in a text, how near to them somebody is addressed, and the rates of capitals,
of loud punctuation and of words spelt to hide. The third turns the trees' margin into a probability by isotonic regression.

Labelled rows are used up to ``LABELLED_ROWS``, drawn by a digest of the identifier; the lexicon has at most ``ENTRIES``
entries. With these bounds the lexicon and the trees travel with the code. All texts are scored whole, in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import Words, byte_table, joined_bytes, release_memory, text_slices, without
from tidemark.session import written

#: Labelled rows that are learned from at most, and entries of the lexicon at most.
LABELLED_ROWS = 20_000
ENTRIES = 4096
#: Letters of the beginnings of words that may be entries, and toxic texts an entry is in at least.
BEGINNINGS = (4, 5, 6)
LEAST_TEXTS = 3
#: Words around a word of the lexicon in which somebody is addressed.
NEAR = 4
#: Labelled rows, of ten, for the lexicon and for the trees; the others calibrate.
LEXICON_TENTHS, TREE_TENTHS = 5, 3
TREES = {"maxIter": 20, "maxDepth": 4, "stepSize": 0.2, "maxBins": 32, "seed": 7}
#: Share of the trees' own probability in the score: keeps the order of texts on a step of the calibration.
OWN_SHARE = 0.001

# Words that address somebody, in English, German, French and Spanish.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner ihr euch euer eure "
    "tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vosotras os vuestro vuestra".split()
)
# Characters that stand for letters in words spelt to hide.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": "", "#": "", "_": ""})

LETTERS_AND_SIGNS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'*@$#_"
WORDS = byte_table(bytes(b for b in range(128) if b not in LETTERS_AND_SIGNS))
HIDDEN = re.compile(r"[^\W\d_][0-9@$*#_]+[^\W\d_]")
LONG_DRAWN = re.compile(r"(.)\1\1")

FEATURES = [
    "word_density", "word_strongest", "word_count", "beginning_density", "beginning_strongest", "beginning_count",
    "near_second_person", "second_person", "capitals", "words_in_capitals", "exclamations", "questions",
    "hidden_words", "hidden_density", "drawn_out", "log_words",
]


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs; with no trees, every text gets ``share``."""

    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float


def entries_of(word: str) -> list[str]:
    """The lexicon's keys for a word: itself, and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in BEGINNINGS if len(word) >= n)]


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS, id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(text, toxic, _tenth): labelled texts, at most ``most`` identifiers of them. A label given twice counts if one is 1."""
    known = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull()).groupBy(id).agg(F.max(F.col(label).cast("int")).alias("_toxic"))
    drawn = known.withColumn("_drawn", F.xxhash64(id, F.lit(1))).orderBy("_drawn", id).limit(most).withColumnRenamed(id, "_id")
    # At most ``most`` small rows, whatever the input: safe to broadcast.
    rows = docs.select(F.col(id).alias("_doc"), F.col(text).alias("text")).join(F.broadcast(drawn), F.col("_doc") == F.col("_id"))
    return rows.select("text", F.col("_toxic").alias("toxic"), F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(10)).cast("int").alias("_tenth"))


def learn_lexicon(rows: DataFrame, entries: int = ENTRIES) -> dict[str, float]:
    """Entries with their weights: the log-odds of a text with the entry against those of any text, shrunk by four texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(0)):
                toxic = batch.column(1).slice(done, len(part)).to_numpy()
                done += len(part)
                yield _entry_counts(Words(part, WORDS), toxic)
        release_memory()

    counts = rows.select("text", "toxic").mapInArrow(count, "entry string, n_toxic bigint, n bigint")
    summed = counts.groupBy("entry").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n").alias("n"))
    whole = rows.agg(F.avg("toxic")).first()[0] or 0.0
    share = (F.col("n_toxic") + 4 * whole) / (F.col("n") + 4)
    weight = F.log(share / (1 - share)) - float(np.log(whole / (1 - whole)))
    best = summed.where(F.col("n_toxic") >= LEAST_TEXTS).withColumn("weight", weight).where("weight > 1")
    return {row.entry: row.weight for row in best.orderBy(F.desc("weight"), F.desc("n_toxic"), "entry").limit(entries).collect()}


def _entry_counts(words: Words, toxic: np.ndarray) -> pa.RecordBatch:
    """Texts of a slice that hold each entry, toxic ones and all."""
    coded = words.words.dictionary_encode()
    names: dict[str, int] = {}
    width = 1 + len(BEGINNINGS)
    table = np.full((len(coded.dictionary), width), -1, np.int64)
    for i, word in enumerate(coded.dictionary.to_pylist()):
        for k, entry in enumerate(entries_of(word.decode().lower())):
            table[i, k] = names.setdefault(entry, len(names))
    place = np.repeat(np.arange(len(words.starts) - 1), np.diff(words.starts))
    entry = table[coded.indices.to_numpy()]
    pairs = (place[:, None] * max(len(names), 1) + entry)[entry >= 0]
    text, entry = np.divmod(np.unique(pairs), max(len(names), 1))
    n = np.bincount(entry, minlength=len(names))
    hits = np.bincount(entry, weights=toxic[text], minlength=len(names)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(hits), pa.array(n)], ["entry", "n_toxic", "n"])


def features_of(texts: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """One row of ``FEATURES`` per text; a NULL text is an empty one."""
    words = Words(texts, WORDS)
    coded = words.words.dictionary_encode()
    vocabulary = [word.decode() for word in coded.dictionary.to_pylist()]
    known = np.zeros((len(vocabulary), 7))  # own weight, beginning's weight, second person, capitals, hidden, hidden weight, drawn out
    for i, cased in enumerate(vocabulary):
        word = cased.lower()
        known[i, :2] = _weights(word, lexicon)
        known[i, 2] = word in SECOND_PERSON
        known[i, 3] = len(cased) > 1 and cased.isupper()
        if not word.isalpha() and HIDDEN.search(word):
            known[i, 4], known[i, 5] = 1, max(_weights(word.translate(DISGUISES), lexicon))
        known[i, 6] = LONG_DRAWN.search(word) is not None
    n = np.diff(words.starts)
    of_word = known[coded.indices.to_numpy()]
    any_hit = (of_word[:, 0] > 0) | (of_word[:, 1] > 0) | (of_word[:, 5] > 0)
    addressed = np.concatenate([[0], np.cumsum(of_word[:, 2])])
    at = np.arange(len(of_word))
    first, last = np.repeat(words.starts[:-1], n), np.repeat(words.starts[1:], n)
    near = any_hit & (addressed[np.minimum(at + NEAR + 1, last)] > addressed[np.maximum(at - NEAR, first)])

    def total(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[words.starts])

    def highest(values: np.ndarray) -> np.ndarray:
        out, full = np.zeros(len(n)), np.flatnonzero(n)
        if len(full):
            out[full] = np.maximum.reduceat(values, words.starts[full])
        return out

    data, starts = joined_bytes(texts)
    capital, letter, loud, asking = (np.diff(np.concatenate([[0], np.cumsum(x)])[starts]) for x in _bytes_in_question(data))
    some = np.maximum(n, 1)
    columns = [
        total(of_word[:, 0]) / some, highest(of_word[:, 0]), np.log1p(total(of_word[:, 0] > 0)),
        total(of_word[:, 1]) / some, highest(of_word[:, 1]), np.log1p(total(of_word[:, 1] > 0)),
        total(near) / np.maximum(total(any_hit), 1), total(of_word[:, 2]) / some,
        capital / np.maximum(letter, 1), total(of_word[:, 3]) / some, loud / some, asking / some,
        total(of_word[:, 4]) / some, total(of_word[:, 5]) / some, total(of_word[:, 6]) / some, np.log1p(n),
    ]
    return np.stack(columns, axis=1)


def _weights(word: str, lexicon: dict[str, float]) -> tuple[float, float]:
    own, *beginnings = (lexicon.get(entry, 0.0) for entry in entries_of(word))
    return own, max(beginnings, default=0.0)


def _bytes_in_question(data: np.ndarray) -> tuple[np.ndarray, ...]:
    capital = (data >= 65) & (data <= 90)
    return capital, capital | ((data >= 97) & (data <= 122)), data == ord("!"), data == ord("?")


def with_features(df: DataFrame, lexicon: dict[str, float], text: str = "text", out: str = "features") -> DataFrame:
    """``df`` without its text, and a vector of ``FEATURES``."""
    others = [c for c in df.columns if c != text]
    kept = df.select(*[F.col(f"`{c}`") for c in others], F.col(text).alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + ["_features array<double>"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in text_slices(batch.column(len(others))):
                rows = features_of(part, lexicon)
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
                columns = [batch.column(i).slice(done, len(part)) for i in range(len(others))]
                yield pa.RecordBatch.from_arrays([*columns, made], [*others, "_features"])
                done += len(part)
        release_memory()

    return kept.mapInArrow(measure, schema).withColumn(out, array_to_vector("_features")).drop("_features")


def learn_toxicity(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS, entries: int = ENTRIES, **columns: str) -> ToxicityModel:
    """A model from the labelled rows among ``docs``; see ``labelled_rows`` for the columns.

    Where one of the three parts lacks a class, all three steps learn from all rows. With one class only, or no label at
    all, there are no trees, and each text gets the share of toxic ones (0 without labels).
    """
    rows = written(labelled_rows(docs, labels, most, **columns), "labelled")
    part = F.when(F.col("_tenth") < LEXICON_TENTHS, 0).when(F.col("_tenth") < LEXICON_TENTHS + TREE_TENTHS, 1).otherwise(2)
    counts = {(r.part, r.toxic): r["count"] for r in rows.groupBy(part.alias("part"), "toxic").count().collect()}
    n, n_toxic = sum(counts.values()), sum(c for (_, toxic), c in counts.items() if toxic)
    if n_toxic in (0, n):
        return ToxicityModel({}, None, None, n_toxic / n if n else 0.0)
    apart = all((p, toxic) in counts for p in range(3) for toxic in (0, 1))

    def share(number: int) -> Column:
        return part == number if apart else F.lit(True)

    lexicon = learn_lexicon(rows.where(share(0)), entries)
    measured = written(with_features(rows.withColumn("label", F.col("toxic").cast("double")), lexicon), "features")
    # The bounded sample in few partitions: growing trees is many short jobs.
    trees = GBTClassifier(featuresCol="features", labelCol="label", **TREES).fit(measured.where(share(1)).coalesce(4))
    margins = trees.transform(measured.where(share(2))).select("label", _margin())
    calibration = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_calibrated").fit(margins)
    return ToxicityModel(lexicon, trees, calibration, n_toxic / n)


def _margin() -> Column:
    return F.element_at(vector_to_array("rawPrediction"), 2).alias("_margin")


def score_toxicity(docs: DataFrame, model: ToxicityModel, id: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """Rows (id, ``out``): how likely each text is toxic, from 0 to 1.

    Edge cases: a NULL or empty text has no words and gets what the trees say of that. Equal or NULL identifiers and repeated rows are
    scored row by row, and equal texts alike. Texts of any length are read whole. An empty table gives an empty one. Other
    columns are ignored.
    """
    docs = without(docs.select(F.col(id).alias("_id"), F.col(text).alias("_words")), "_features")
    if model.trees is None:
        return docs.select(F.col("_id").alias(id), F.lit(model.share).alias(out))
    measured = with_features(docs, model.lexicon, text="_words", out="features")
    judged = model.trees.transform(measured).select("_id", _margin(), F.element_at(vector_to_array("probability"), 2).alias("_own"))
    calibrated = model.calibration.transform(judged)
    score = (1 - OWN_SHARE) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_calibrated")) + OWN_SHARE * F.col("_own")
    return calibrated.select(F.col("_id").alias(id), score.alias(out))
