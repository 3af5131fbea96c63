"""The registered queries over the given tables, and the DuckDB SQL for those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import language, licenses, mixing, negatives, neighbours, packing, scoring, simhash, spelling, substrings, token_files, topk, toxicity
from ..session import scratch_path
from .storage import read_table


def fold(modulus: int):
    """crc32 of doc_id as text, modulo `modulus`. A null doc_id counts as an empty text: 0, so held out of op8 and op10 and
    part of what op9 learns from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, automaton = language.fit(docs.where(fold(5) != 0))
    return language.identify(docs, langs, automaton).withColumn("held_out", fold(5) == 0)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.highest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.in_service_order(mixing.mix(read_table(spark, sf_dir, "documents"))).drop("source_rank")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents")).drop("detections")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, docs.where(fold(5) != 0), labels.where(fold(5) != 0))
    return toxicity.score(docs, model).withColumn("held_out", fold(5) == 0)


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = scoring.fit(docs.where(fold(7) != 2))
    return scoring.score(docs, model).withColumn("held_out", fold(7) == 2)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "llm-ids")
    token_files.write_ids(read_table(spark, sf_dir, "documents"), path)
    return token_files.read_ids(spark, path)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read_table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_substrings": op2_substrings,
    "op3_topk": op3_topk,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_licenses": op6_licenses,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_language": op10_language,
    "op11_token_files": op11_token_files,
    "op12_spelling": op12_spelling,
    "op13_negatives": op13_negatives,
}
QUERIES["pipeline"] = corpus_pipeline.run
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Queries that SQL can express; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op2_substrings": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
h AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i,
        unnest(list_transform(range(1, len(words) - 33), lambda i: md5(array_to_string(words[i:i + 34], ' ')))) AS t
      FROM w WHERE len(words) >= 35),
g AS (SELECT doc_id, list(i) AS starts FROM h SEMI JOIN (SELECT t FROM h GROUP BY t HAVING count(*) > 1) USING (t) GROUP BY doc_id),
k AS (SELECT doc_id, words, list_distinct(flatten(list_transform(coalesce(starts, []), lambda i: range(i, i + 35)))) AS gone
      FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(words) AS n_words, len(gone) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(words, lambda x, j: NOT list_contains(gone, j)), ' '), '')) AS kept_sha256 FROM k""",
    "op3_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op13_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
      WHERE label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
    "op5_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM d GROUP BY source),
r AS (SELECT 0 AS k, -1e0::DOUBLE AS t UNION ALL
      SELECT k + 1, (SELECT (1.5 * sum(source_size)::DOUBLE - coalesce(sum(2 * source_size) FILTER (2 * source_size <= t * weight), 0))
        / sum(weight) FILTER (NOT 2 * source_size <= t * weight) FROM s) FROM r WHERE k < 40),
c AS (SELECT *, CASE WHEN 2 * source_size <= t * weight THEN (2 * source_size)::DOUBLE ELSE t * weight END AS target
      FROM s, (SELECT max(t) AS t FROM r)),
p AS (SELECT d.doc_id, size, source_size, target, weight,
        sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, floor(target) - upto + size)) + greatest(0, least(size, floor(target) - upto + size - source_size)) AS BIGINT) AS taken,
  upto / weight AS virtual_finish FROM p""",
}
