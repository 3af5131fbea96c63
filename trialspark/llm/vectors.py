"""Vector tables: which rows take part in a search, and top lists per query."""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import store


def usable(vectors: DataFrame, allow_zero: bool) -> DataFrame:
    """(vec_id long, vector array<double>): rows that can be searched, one per vec_id.

    Left out: null vec_ids, null or empty vectors, vectors holding null or non-finite components, zero vectors unless
    allowed, and vectors of another length than most have (the longer on a tie). Of rows with one vec_id the smallest
    vector counts.
    """
    vector = F.col("embedding").cast("array<double>")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & (F.size("vector") > 0))
    rows = rows.where(whole if allow_zero else whole & F.exists("vector", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = store(rows.withColumn("_n", F.size("vector")), "vectors")
    common = rows.groupBy("_n").count().orderBy(F.desc("count"), F.desc("_n")).first()
    return rows.where(F.col("_n") == (common[0] if common else 0)).drop("_n")


def matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best_rows(query, item, score, most):
    """Of (query, item, score) the rows of each query's `most` smallest scores, ties to the smaller item; no repeats."""
    order = np.lexsort((item, score, query))
    query, item, score = query[order], item[order], score[order]
    if len(query):
        new = np.r_[True, (query[1:] != query[:-1]) | (item[1:] != item[:-1]) | (score[1:] != score[:-1])]
        query, item, score = query[new], item[new], score[new]
        first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
        query, item, score = query[rank < most], item[rank < most], score[rank < most]
    return query, item, score


def ranked(found: DataFrame, most: int, ascending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's best rows of a table with a few rows per query and task."""
    score = F.col("score").asc() if ascending else F.col("score").desc()
    by_query = Window.partitionBy("query_id").orderBy(score, "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= most).select("query_id", "rank", "vec_id", "score")
