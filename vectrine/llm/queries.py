"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrine.llm.ballhash import near_groups, near_pairs
from vectrine.llm.coverage import varied_subset
from vectrine.llm.knn import nearest, neighbours_of_all, raw_bytes
from vectrine.llm.leakage import MATCH, SPAN, exact_leaks, leaks
from vectrine.llm.linkage import described_clusters, linked_clusters
from vectrine.llm.quality import is_junk, text_quality
from vectrine.llm.tokenize import encode_texts
from vectrine.operators.records import usable_records
from vectrine.session import materialize, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: Elements of a usable vector.
WIDTH = 128


def usable(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Current usable records, written once: ``(id, vector, *extra)``."""
    return materialize(usable_records(table(spark, sf_dir, "vectors"), *extra, dimension=WIDTH), "usable")


@query
def p1_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A varied subset of a fiftieth of the usable records."""
    records = usable(spark, sf_dir)
    return varied_subset(records, -(-records.count() * 2 // 100), WIDTH).select("id", F.round("gain", 6).alias("gain"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_clusters(usable(spark, sf_dir), WIDTH)


@query
def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by average linkage with their size and their three most typical members."""
    found = described_clusters(usable(spark, sf_dir, "metadata"), WIDTH)
    return found.withColumn("closeness", F.round("closeness", 9))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(usable(spark, sf_dir), WIDTH)


@query
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable id with its group of near copies and its number of links."""
    return near_groups(usable(spark, sf_dir), WIDTH)


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, probes = usable(spark, sf_dir), table(spark, sf_dir, "knn_probes")
    most = probes.agg(F.max("k")).first()[0] or 1
    asked = probes.where(F.col("k") > 0).join(records, "id").select(F.col("probe_id").alias("query"), F.col("id").alias("own"), "k", raw_bytes("vector").alias("raw"))
    return nearest(records, asked, WIDTH, most).select(F.col("query").alias("probe_id"), "id")


@query
def p6_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every usable record."""
    found = neighbours_of_all(usable(spark, sf_dir), WIDTH, 10)
    return found.select(F.col("query").alias("id"), F.col("id").alias("near_id"), "n", F.round("similarity", 9).alias("similarity"))


@query
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    path = os.environ.get("TOKENIZER_RANKS") or tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_texts(table(spark, sf_dir, "documents"), path, tokenizers.PATTERN)


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@query
def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item that share a seed, with their alignment; ``leaked`` where it scores as much as a whole window of words or a whole shorter item."""
    items = table(spark, sf_dir, "eval_items")
    return leaks(table(spark, sf_dir, "documents"), items).withColumn("leaked", (F.col("score") >= MATCH * SPAN) | ((F.col("share") == 1) & (F.col("score") < MATCH * SPAN)))


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words")).where(is_junk()).select("doc_id")


@query
def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
    return found.select("doc_id", "n_words", "n_chars", "n_lines", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "punctuation_share", "common_share")])


@query
def p9_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics once more, every text in chunks of 256 characters, merged by border states."""
    found = text_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"), chunk=256)
    return found.select("doc_id", "n_words", "n_chars", "n_lines", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "punctuation_share", "common_share")])


USABLE = """
u AS (SELECT id, vector::DOUBLE[] AS v FROM (
  SELECT id, vector, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN "timestamp" IS NULL OR "timestamp" = 0 THEN last_accessed ELSE "timestamp" END DESC NULLS LAST, ingested_at DESC NULLS LAST) AS n
  FROM vectors WHERE id IS NOT NULL) WHERE n = 1 AND len(vector) = 128 AND len(list_filter(vector, lambda x: isfinite(x))) = 128 AND len(list_filter(vector, lambda x: x <> 0)) > 0)
"""
SQL["p3_found"] = f"WITH {USABLE} SELECT a.id AS id_a, b.id AS id_b FROM u a JOIN u b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.99"
SQL["p4_found"] = f"""WITH RECURSIVE {USABLE},
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.74),
reached(id, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM reached r JOIN e ON e.a = r.id WHERE e.b > r.root)
SELECT min(root) AS cluster_id, id FROM reached GROUP BY id"""
SQL["p6_found"] = f"""WITH {USABLE} SELECT probe_id, id FROM (
SELECT probe_id, k, b.id, row_number() OVER (PARTITION BY probe_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS n
FROM knn_probes p JOIN u a ON a.id = p.id JOIN u b ON b.id <> p.id) WHERE n <= k"""
SQL["p6_all"] = f"""WITH {USABLE} SELECT id, near_id, n::INT AS n, s AS similarity FROM (
SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, near_id) AS n FROM (SELECT a.id, b.id AS near_id, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM u a JOIN u b ON a.id <> b.id)) WHERE n <= 10"""

SQL["p8_found"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[p:p + 11], ' ') g FROM d, unnest(range(1, len(w) - 10)) t(p)),
ig AS (SELECT item_id, array_to_string(w[p:p + 11], ' ') g FROM i, unnest(range(1, len(w) - 10)) t(p))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""

STATISTICS = r"""
t AS (SELECT doc_id, row_number() OVER () AS n, coalesce(text, '') AS text FROM documents),
w AS (SELECT n, unnest(regexp_extract_all(text, '[^ \t\n\r\x{00A0}]+')) AS w FROM t),
wa AS (SELECT n, count(*) AS n_words, sum(length(w)) AS n_chars, sum(length(regexp_replace(w, '[^\p{L}\p{N}]+', '', 'g'))) AS alnum,
  count(*) FILTER (regexp_replace(regexp_replace(lower(w), '^[^\p{L}]+', ''), '[^\p{L}]+$', '') IN (SELECT word FROM common_words)) AS hits FROM w GROUP BY n),
l AS (SELECT n, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS l FROM t),
la AS (SELECT n, count(*) AS n_lines, count(*) FILTER (right(l, 1) IN ('.', '!', '?', '…', '"')) AS ends FROM l WHERE l <> '' GROUP BY n),
s AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_chars, 0)::BIGINT AS n_chars, coalesce(n_lines, 0)::BIGINT AS n_lines,
  n_chars / n_words AS mean_word_length, (n_chars - alnum) / n_chars AS symbol_ratio, ends / n_lines AS punctuation_share, hits / n_words AS common_share
  FROM t LEFT JOIN wa USING (n) LEFT JOIN la USING (n))
"""
SQL["p9_statistics"] = f"WITH {STATISTICS} SELECT doc_id, n_words, n_chars, n_lines, round(mean_word_length, 6) AS mean_word_length, round(symbol_ratio, 6) AS symbol_ratio, round(punctuation_share, 6) AS punctuation_share, round(common_share, 6) AS common_share FROM s"
SQL["p9_chunked"] = SQL["p9_statistics"]
SQL["p9_found"] = f"""WITH {STATISTICS} SELECT doc_id FROM s WHERE n_words >= 10 AND
coalesce((mean_word_length < 2.5 OR mean_word_length > 10)::INT, 0) + coalesce((symbol_ratio > 0.2)::INT, 0) + coalesce((punctuation_share < 0.5)::INT, 0) + coalesce((common_share < 0.2)::INT, 0) >= 2"""
