"""Mixing sources to target weights by weighted fair queueing.

Every source sends its documents in shuffled order, again and again; a word's virtual time is the number of words its
source has sent up to it, divided by the source's weight. Serving words by virtual time gives each source its share. The
mix is cut at the virtual time at which the budget is reached; a document being sent at that moment is taken in part.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import store

SPACES = " \t\n\x0b\f\r"
WEIGHTS = (5, 2, 1)
#: Documents of a source that one task orders.
BLOCK = 2000


def n_words(text):
    """Number of words `[^\\x20\\x09-\\x0D]+`; 0 for null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))).otherwise(0).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_share=1.5, most_passes=2) -> tuple[DataFrame, float]:
    """(source_rank, source, source_size, documents, weight, target) per source, and the virtual time of the cut.

    Sources in code point order, null last, get the weights in turn. Targets are proportional to weight, at most
    `most_passes` times the source; what that leaves over goes to the others by weight until none is above.
    """
    spark = sizes.sparkSession
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents")).orderBy(F.col("source").asc_nulls_last())
    rows = sums.rdd.zipWithIndex().map(lambda x: (x[1], x[0].source, x[0].source_size, x[0].documents, float(weights[x[1] % len(weights)])))
    ranked = store(spark.createDataFrame(rows, "source_rank long, source string, source_size long, documents long, weight double"), "sources")
    most = F.col("source_size") * most_passes
    budget = budget_share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    time = -1.0
    while True:
        full = most <= time * F.col("weight")
        fixed, open_weight = ranked.agg(F.coalesce(F.sum(F.when(full, most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        before, time = time, (budget - fixed) / open_weight if open_weight else time
        if time <= before:
            break
    target = F.when(most <= time * F.col("weight"), most.cast("double")).otherwise(time * F.col("weight"))
    return ranked.withColumn("target", target), max(time, 0.0)


def mix(docs: DataFrame, weights=WEIGHTS, budget_share=1.5, most_passes=2, keep=("doc_id",), block=BLOCK) -> DataFrame:
    """Columns `keep` plus size, source_size, target, taken, virtual_finish; one row per row of `docs`.

    taken: words the mix takes of the row, repeats counted, at most `most_passes` * size. virtual_finish: when its first
    pass ends. The shuffled order is by a hash of doc_id, so reruns agree. A null text has size 0 and nothing to take; a null
    source is a source. Rows that are repeated are sent one after another. `keep` cannot hold the names of the result columns.

    The running sum inside a source is made of blocks cut by the hash, so that no task orders a whole source: sums per
    block, offsets over the blocks, and a window inside each.
    """
    sized = docs.select(*[F.col(c) for c in keep if c != "source"], "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")).alias("_place"))
    sized = store(sized, "sizes")
    sources, _ = source_targets(sized.select("source", "size"), weights, budget_share, most_passes)
    rows = sized.count()
    digits = next(d for d in range(1, 33) if block * 16**d >= rows)
    ranks = sources.select("source_rank", "source", "source_size", "weight", "target").withColumnRenamed("source", "_source")
    tagged = sized.join(ranks, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_block", F.substring("_place", 1, digits))
    blocks = tagged.groupBy("source_rank", "_block").agg(F.sum("size").alias("_sum"))
    order = Window.partitionBy("source_rank").orderBy("_block")
    offsets = blocks.withColumn("_offset", F.sum("_sum").over(order) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy("source_rank", "_block").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sent = tagged.withColumn("_upto", F.sum("size").over(inside)).join(offsets, ["source_rank", "_block"])
    before = F.col("_offset") + F.col("_upto") - F.col("size")
    quota = F.floor("target").cast("long")
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), quota - before - p * F.col("source_size"))) for p in range(most_passes)), F.lit(0).cast("long"))
    return sent.select(*keep, "size", "source_size", "target", taken.alias("taken"), ((before + F.col("size")) / F.col("weight")).alias("virtual_finish"), "source_rank")


def in_service_order(mixed: DataFrame) -> DataFrame:
    """The rows range-sorted by virtual finish time over all sources."""
    return mixed.orderBy("virtual_finish", "source_rank", "doc_id")


def copies(mixed: DataFrame, text="text") -> DataFrame:
    """The mix itself: a row for each pass that takes words, with the words taken of its text; the last may be a part."""
    size, taken = F.col("size"), F.col("taken")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    part = F.when(size > 0, taken % size).otherwise(0).cast("int")
    words = F.split(F.btrim(F.col(text), F.lit(SPACES)), "[ \\t\\n\\x0B\\f\\r]+")
    cut = F.when(F.col("_words") > 0, F.array_join(F.slice(words, F.lit(1), F.col("_words")), " ")).otherwise(F.col(text))
    takes = F.concat(F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    return mixed.withColumn("_words", F.explode(takes)).withColumn(text, cut).drop("_words")
