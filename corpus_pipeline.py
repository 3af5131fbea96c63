"""A corpus from raw documents: language ID, near-duplicates, repeated passages, source mix, packed sequences.

Each stage takes the documents that its predecessor kept and returns documents (doc_id, text, lang, source, n_chars); the
last returns the pieces of the packed sequences. Other columns of the input are left behind.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import language, mixing, packing, simhash, substrings
from trialspark.llm.storage import store

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle and differing bits of a link, those of `op4_simhash`.
SHINGLE, MOST_BITS = 3, 3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the texts that have a language; lang is the predicted one. Goes: null texts and those without a letter.

    The models are learned from the labelled rows of the input. If there are none, no text has a language.
    """
    docs = docs.select(*DOCUMENT)
    langs, automaton = language.fit(docs)
    found = language.identify(docs, langs, automaton, keep=DOCUMENT).where(F.col("lang_pred") != language.UNDETERMINED)
    return found.withColumn("lang", F.col("lang_pred")).select(*DOCUMENT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts linked by fingerprints that differ in at most `MOST_BITS` bits. The row with the
    smallest doc_id stays, of several with that the one with the smallest hash of its text.

    Rows that share a doc_id are told apart by their texts. Rows without a doc_id all stay.
    """
    docs = docs.select(*DOCUMENT)
    place = (F.xxhash64("text").alias("text_key"), F.xxhash64("lang", "source", "n_chars").alias("row_key"))
    named = docs.where(F.col("doc_id").isNotNull()).select("*", *place)
    order = ["doc_id", "text_key", "row_key"]
    groups = simhash.near_duplicates(named, SHINGLE, MOST_BITS, keep=("text_key", "row_key"))
    first = groups.groupBy("component_id").agg(F.min(F.struct(*order)).alias("first")).select("first.*")
    kept = named.join(first, order, "left_semi").dropDuplicates(order)
    return kept.select(*DOCUMENT).unionByName(docs.where(F.col("doc_id").isNull())).select(*DOCUMENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words under repeated windows of 35 words from every text; texts of which nothing is left go.

    A text without such words stays as it is; of others the words left are joined by single spaces.
    """
    cut = substrings.remove_repeats(docs.select(*DOCUMENT), keep=DOCUMENT)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    kept = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken, at most twice; the last document of a source may be taken in
    part, and what is not taken goes. Texts without words take no part."""
    mixed = mixing.mix(docs.select(*DOCUMENT), keep=DOCUMENT)
    return mixing.copies(mixed).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's tokens in power-of-two pieces; a document taken twice is packed twice."""
    return packing.pack(docs.select(*DOCUMENT))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language models, components and byte-pair tokens are beyond SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; every stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
