"""One query per operator over the whole of its table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import private
from tidemark.llm.arrays import small_batches
from tidemark.llm.byte_runs import remove_repeated_bytes
from tidemark.llm.collocations import mine_collocations
from tidemark.llm.decontaminate import find_benchmark
from tidemark.llm.private import find_private_spans
from tidemark.llm.line_runs import remove_repeated_lines
from tidemark.llm.near_duplicates import link_near_duplicates
from tidemark.llm.packed_files import read_packed, write_packed
from tidemark.llm.packing import pack_documents
from tidemark.llm.periodic_runs import find_periodic_runs
from tidemark.llm.quality import score_quality
from tidemark.llm.sharding import shard_by_bytes, text_crc32
from tidemark.llm.toxicity import learn_toxicity, score_toxicity
from tidemark.llm.warc import checked_payloads, read_archives, write_archives
from tidemark.session import new_table_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/documents.parquet").select(*(columns or ("doc_id", "text")))


def collocation_sql(least: int, top: int) -> str:
    return rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
  FROM documents),
word AS (SELECT lang, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM piece),
gram AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM word, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
total AS (SELECT lang, sum(len(w)) AS n FROM word GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= {least}),
candidate AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (
  SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n, c.cut, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidate) AS c
  JOIN f AS x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN f AS y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1 :], ' ')
  JOIN total ON total.lang = c.lang),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_part AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, a
  FROM (SELECT lang, w, a, k, size, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM candidate WHERE k > 2))),
kept AS (SELECT * FROM lowest ANTI JOIN inner_part USING (lang, phrase, a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= {top}
"""


@query
def op3_quality_rules(spark, folder):
    """Counts and verdict of each document."""
    return score_quality(documents(spark, folder)).drop("text")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s.kind.isin(*kinds))


def listed(spans: Column) -> Column:
    parts = F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")))
    return F.array_join(parts, ",")


@query
def op4_private_data(spark, folder):
    """Spans of personal data in each document: the base kinds counted and digested, all listed."""
    spans = F.col("private_spans")
    counts = [F.size(of_kinds(spans, kind)).cast("bigint").alias(f"n_{kind}") for kind in private.BASE_KINDS]
    base = of_kinds(spans, *private.BASE_KINDS)
    found = find_private_spans(documents(spark, folder))
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


@query
def op6_benchmark_decontamination(spark, folder):
    """Words of each document that are inside a window of a benchmark item."""
    found = find_benchmark(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL["op6_benchmark_decontamination"] = r"""
WITH doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS part
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
place AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS part
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, place.n, item_id FROM place JOIN win USING (n, part)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query
def op8_warc_archive(spark, folder):
    """All pages written as WARC records and read back."""
    path = new_table_path(spark, "warc")
    write_archives(spark.read.parquet(f"{folder}/pages.parquet"), path)
    back = checked_payloads(read_archives(spark, path))
    return back.select(
        F.col("page").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


SQL["op8_warc_archive"] = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
         min(page_id) OVER (PARTITION BY html) AS first
  FROM pages)
"""


@query
def op1_histogram_sharding(spark, folder):
    """Documents in 16 shards of near equal bytes."""
    sharded = shard_by_bytes(documents(spark, folder), 16)
    return sharded.select(
        "doc_id",
        "size",
        text_crc32("text").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


END_ID = 2


@query
def op7_best_fit_packing(spark, folder):
    """Documents as tokens in sequences of at most 4096."""
    return pack_documents(documents(spark, folder), tokenizer_path(), END_ID)


@query
def op10_packed_token_files(spark, folder):
    """Documents written as packed id matrices and read back: a row per sequence, matrices as digests."""
    path = new_table_path(spark, "packed")
    write_packed(documents(spark, folder), path, tokenizer_path(), END_ID)
    packed = read_packed(spark, path)
    return packed.select(
        "sequence_id",
        "n_tokens",
        "n_segments",
        F.crc32("ids").alias("ids_crc32"),
        F.crc32("positions").alias("positions_crc32"),
        F.array_join(F.col("cu_seqlens").cast("array<string>"), ",").alias("cu_seqlens"),
        F.array_join(F.col("segment_docs").cast("array<string>"), ",", "null").alias("segment_docs"),
        F.array_join(F.col("segment_starts").cast("array<string>"), ",").alias("segment_starts"),
    )


@query
def op9_line_runs(spark, folder):
    """Lines of each document, those deleted as later copies of repeated runs, and a digest of the rest."""
    cut = remove_repeated_lines(documents(spark, folder))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return cut.select("doc_id", "n_lines", "n_removed", "n_runs", digest)


@query
def op5_odd_sketch_near_duplicates(spark, folder):
    """Components of documents that share 85 percent of their shingles."""
    return link_near_duplicates(documents(spark, folder), percent=85)


SQL["op5_odd_sketch_near_duplicates"] = r"""
WITH RECURSIVE seq AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM seq WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
text_class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS rep FROM seq WHERE len(w) > 0),
own AS (SELECT s, doc_id FROM shingle WHERE doc_id IN (SELECT rep FROM text_class)),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM own a JOIN own b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
  UNION SELECT rep, doc_id FROM text_class WHERE rep < doc_id),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS node, doc_id AS other FROM n UNION SELECT node, b FROM reach JOIN step ON a = other),
part AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN part ON node = doc_id
"""


@query
def op2_suffix_array_repeats(spark, folder):
    """Bytes of each document that repeat 50-byte strings of earlier ones, removed."""
    cut = remove_repeated_bytes(documents(spark, folder))
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Every tenth document, by a digest of its identifier, with the words behind a drawn place repeated from there."""
    drawn = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(drawn / 10).cast("bigint")
    trimmed = F.trim("text", F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    words = F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+"))
    n = F.size("_words").cast("bigint")
    begin, period = F.try_mod(F.col("_g"), n).cast("int"), F.lit(1) + F.floor((n - F.col("_begin")) / (3 + F.col("_g") % 8)).cast("int")
    rest = n.cast("int") - F.col("_begin")
    times = F.ceil(rest / F.col("_period")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_words", F.col("_begin") + 1, F.col("_period")), times)), F.lit(1), rest)
    made = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_begin")), tail), " ")
    chosen = docs.withColumns({"_g": g, "_words": F.when(drawn % 10 == 0, words)})
    placed = chosen.withColumn("_begin", begin).withColumn("_period", period)
    return placed.select("doc_id", F.when(F.size("_words") > 0, made).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark, folder):
    """Runs of each document: their number, the longest, and digests of all of them and of the text without repetitions."""
    found = find_periodic_runs(with_periodic_tails(documents(spark, folder)))
    ranked = F.transform("runs", lambda run: F.struct(-run.length, run.start, run.period))
    longest = F.array_min(ranked)
    lines = F.transform("runs", lambda run: F.concat_ws(",", run.start.cast("string"), run.length.cast("string"), run.period.cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    found = found.withColumn("_longest", longest)
    start, length, period = F.col("_longest.start"), -F.col("_longest.col1"), F.col("_longest.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op13_toxicity(spark, folder):
    """A toxicity score of each document, learned from four fifths of the labels."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    model = learn_toxicity(docs, labels.where(~held_out))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op11_collocations(spark, folder):
    """The best 2000 phrases of each language."""
    return mine_collocations(documents(spark, folder, "lang", "text"))


SQL["op11_collocations"] = collocation_sql(100, 2000)
