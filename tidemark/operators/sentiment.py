"""Lexicon sentiment of texts, as a fold over the words of each."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clean_text, tokens
from tidemark.session import written

# Normalisation and word rules of the published VADER compound score (Hutto and Gilbert
# 2014, MIT licence), as words without apostrophes, since cleaning takes those out.
ALPHA = 15
DIGITS = 4
BOOST = 0.293
BOOST_FADE = (1.0, 0.95, 0.9)
NEGATION_FACTOR = -0.74
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "despite", "didnt", "doesnt", "dont", "hadnt", "hasnt",
    "havent", "isnt", "mightnt", "mustnt", "neednt", "neither", "never", "no", "none", "nope", "nor", "not", "nothing",
    "nowhere", "oughtnt", "rarely", "seldom", "shant", "shouldnt", "uhuh", "wasnt", "werent", "without", "wont", "wouldnt",
]
STRONGER = [
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably", "decidedly", "deeply", "effing",
    "enormous", "enormously", "entirely", "especially", "exceptional", "exceptionally", "extreme", "extremely",
    "fabulously", "flippin", "flipping", "fully", "greatly", "hella", "highly", "hugely", "incredible", "incredibly",
    "intensely", "major", "majorly", "more", "most", "particularly", "purely", "quite", "really", "remarkably", "so",
    "substantially", "thoroughly", "total", "totally", "tremendous", "tremendously", "uber", "unbelievably", "unusually",
    "utter", "utterly", "very",
]
WEAKER = [
    "almost", "barely", "hardly", "kinda", "kindof", "less", "little", "marginal", "marginally", "occasional",
    "occasionally", "partly", "scarce", "scarcely", "slight", "slightly", "somewhat", "sorta", "sortof",
]


@dataclass(frozen=True)
class Modifiers:
    """Words that flip, strengthen or weaken the valence of a word up to three places on."""

    negations: tuple[str, ...] = tuple(NEGATIONS)
    stronger: tuple[str, ...] = tuple(STRONGER)
    weaker: tuple[str, ...] = tuple(WEAKER)


# A short list to try things out with: any (token, valence) DataFrame can take its place. Valences go
# from -4 to 4, those of common words as in the published VADER lexicon (MIT licence); words of the
# market and of abuse have values of our own.
WORDS = {
    "amazing": 2.8, "bad": -2.5, "best": 3.2, "bullish": 2.0, "bearish": -2.0, "clown": -1.2, "crash": -2.4,
    "disgusting": -2.4, "excellent": 2.7, "fail": -2.5, "gain": 2.0, "good": 1.9, "great": 3.1, "happy": 2.7,
    "hate": -2.7, "idiot": -2.3, "loser": -2.4, "loss": -1.3, "love": 3.2, "moron": -2.2, "pathetic": -2.7,
    "profit": 1.9, "scum": -2.5, "strong": 2.3, "stupid": -2.4, "terrible": -2.1, "trash": -1.6, "weak": -1.9,
    "win": 2.8, "worst": -3.1, "worthless": -1.9, "wrong": -2.1,
}


#: Entries, modifiers included, of a lexicon that every task holds; a longer one is joined.
HELD_ENTRIES = 20_000
#: Slots of the table of held entries, by checksum of the word.
SLOTS = 4096

ENTRY = "struct<token:string,valence:double,boost:double,negates:boolean>"
ENTRY_FIELDS = ("token", "valence", "boost", "negates")


def default_lexicon(spark: SparkSession) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(w).alias("token"), F.lit(v).alias("valence")) for w, v in WORDS.items()])
    return spark.range(1).select(F.inline(listed))


def compound(total: Column) -> Column:
    """Sum of valences squeezed into [-1, 1]."""
    return F.round(total / F.sqrt(total * total + ALPHA), DIGITS)


def entries_of(valences: dict[str, float], modifiers: Modifiers | None) -> list[tuple]:
    """(token, valence or None, boost, negates) of every word that matters."""
    tokens_ = set(valences)
    stronger, weaker, negations = (set(), set(), set()) if modifiers is None else map(set, (modifiers.stronger, modifiers.weaker, modifiers.negations))
    tokens_ |= stronger | weaker | negations
    boost = lambda w: BOOST if w in stronger else -BOOST if w in weaker else 0.0
    return [(w, valences.get(w), boost(w), w in negations) for w in sorted(tokens_)]


def held_table(entries: list[tuple]) -> tuple[Column, int]:
    """The entries as one constant, and its number of slots: each slot has the entries whose token's checksum falls there."""
    slots = max(1, min(SLOTS, 2 * len(entries)))
    table: list[list[str]] = [[] for _ in range(slots)]
    for token, valence, boost, negates in entries:
        quoted = "'" + token.replace("\\", "\\\\").replace("'", "\\'") + "'"
        value = "null" if valence is None else f"{float(valence)!r}D"
        fields = ", ".join(f"'{name}', {field}" for name, field in zip(ENTRY_FIELDS, (quoted, f"cast({value} as double)", f"{boost!r}D", str(negates).lower())))
        table[zlib.crc32(token.encode()) % slots].append(f"named_struct({fields})")
    return F.expr("array(" + ", ".join(f"cast(array({', '.join(slot)}) as array<{ENTRY}>)" for slot in table) + ")"), slots


def looked_up(words: Column, entries: list[tuple]) -> Column:
    """For each word its entry, or NULL."""
    table, slots = held_table(entries)

    def entry(word: Column) -> Column:
        slot = F.get(table, (F.crc32(word.cast("binary")) % slots).cast("int"))
        return F.get(F.filter(slot, lambda e: e["token"] == word), F.lit(0))

    return F.transform(words, entry)


def folded(entries: Column, but_at: Column | None, negation: bool) -> Column:
    """Sum of the valences of a text from the entries of its words, in order."""
    if not negation:
        return F.aggregate(entries, F.lit(0.0), lambda total, e: total + F.coalesce(e["valence"], F.lit(0.0)))
    nothing = F.struct(F.lit(0.0).alias("boost"), F.lit(False).alias("negates"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(1).alias("at"), nothing.alias("b1"), nothing.alias("b2"), nothing.alias("b3"))

    def advance(state: Column, e: Column) -> Column:
        before = [state["b1"], state["b2"], state["b3"]]
        boost = sum((b["boost"] * fade for b, fade in zip(before, BOOST_FADE)), F.lit(0.0))
        negated = before[0]["negates"] | before[1]["negates"] | before[2]["negates"]
        scaled = e["valence"] + F.signum(e["valence"]) * boost
        side = F.when(but_at == 0, 1.0).when(state["at"] < but_at, BEFORE_BUT).when(state["at"] > but_at, AFTER_BUT).otherwise(1.0)
        value = F.when(e["valence"].isNotNull(), F.when(negated, scaled * NEGATION_FACTOR).otherwise(scaled) * side).otherwise(0.0)
        own = F.struct(F.coalesce(e["boost"], F.lit(0.0)).alias("boost"), F.coalesce(e["negates"], F.lit(False)).alias("negates"))
        return F.struct(
            (state["total"] + value).alias("total"), (state["at"] + 1).alias("at"), own.alias("b1"), state["b1"].alias("b2"), state["b2"].alias("b3")
        )

    return F.aggregate(entries, start, advance, lambda state: state["total"])


def joined_entries(rows: DataFrame, lexicon: DataFrame, modifiers: Modifiers | None) -> DataFrame:
    """Rows of (``_row``, ``_words``) with ``_entries``, for a lexicon of any length: a join by word over written rows.

    Only words that are listed come back to their text, each with its places.
    """
    spark = rows.sparkSession
    listed = lexicon.groupBy("token").agg(F.sum(F.col("valence").cast("double")).alias("valence"))
    changing = spark.createDataFrame([e for e in entries_of({}, modifiers)], "token string, valence double, boost double, negates boolean")
    table = listed.join(changing.drop("valence"), "token", "full")
    words = rows.select("_row", F.posexplode("_words").alias("_place", "token"))
    hits = words.join(table, "token").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_place", F.struct(*ENTRY_FIELDS)))).alias("_hits"))
    both = rows.join(hits, "_row", "left")
    entries = F.transform("_words", lambda _, i: F.try_element_at("_hits", i))
    return both.withColumn("_entries", F.when(F.col("_hits").isNotNull(), entries).otherwise(F.array().cast(f"array<{ENTRY}>")))


def lexicon_score(
    df: DataFrame,
    text: str = "tweet",
    id: str | None = None,
    lexicon: DataFrame | None = None,
    negation: bool = False,
    keep: tuple[str, ...] = (),
    out: str = "sentiment",
    modifiers: Modifiers = Modifiers(),
    held_entries: int = HELD_ENTRIES,
) -> DataFrame:
    """Compound polarity per text: (id, *keep, out), 0 where no word is known; one row per row of ``df``.

    A text is read once and scored where it stands, by a fold over its words; nothing is shuffled. Each task holds the
    lexicon as a constant, up to ``held_entries`` entries. A longer one is joined by word with a written copy of the rows. With
    ``negation`` the three words before a word may flip or scale it (``modifiers``), and 'but' shifts the weight to
    what follows. Valences of a token listed twice add up.
    """
    kept = [*([id] if id else []), *keep]
    words = tokens(clean_text(text))
    used = modifiers if negation else None
    if lexicon is None:
        valences: dict[str, float] | None = dict(WORDS)
    else:
        listed = lexicon.select("token", F.col("valence").cast("double").alias("valence")).na.drop().limit(held_entries + 1).collect()
        valences = {}
        for row in listed:
            valences[row.token] = valences.get(row.token, 0.0) + row.valence
        valences = valences if len(listed) <= held_entries else None
    if valences is not None:
        rows = df.select(*kept, words.alias("_words"))
        entries = looked_up(F.col("_words"), entries_of(valences, used))
    else:
        rows = written(df.select(*kept, words.alias("_words")).withColumn("_row", F.monotonically_increasing_id()), "words")
        rows, entries = joined_entries(rows, lexicon.select("token", "valence").na.drop(), used), F.col("_entries")
    total = folded(entries, F.array_position("_words", "but") if negation else None, negation)
    return rows.select(*kept, compound(total).alias(out))
