"""Searches over vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.llm import neighbours, topk
from trialspark.llm.queries import QUERIES


def vectors_of(rows):
    ids = np.array([r["vec_id"] for r in rows])
    return ids, np.array([r["embedding"] for r in rows], dtype=np.float64)


def nearest(ids, x, q, k):
    far = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [i for i in np.lexsort((ids, far)) if i != q][:k]
    return [int(ids[i]) for i in order]


def highest(ids, v, q, k):
    score = v @ v[q]
    order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
    return [(int(ids[i]), int(score[i])) for i in order]


def grouped(rows, *columns):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns))
    return out


def test_op1_and_op3_on_the_small_table(spark, small_dir, table):
    ids, x = vectors_of(table("embeddings"))
    got = grouped(QUERIES["op1_neighbours"](spark, small_dir).collect(), "vec_id")
    assert got == {int(i): nearest(ids, x, q, 10) for q, i in enumerate(ids) if i % 100 == 0}
    got = grouped(QUERIES["op3_topk"](spark, small_dir).collect(), "vec_id", "score")
    whole = np.floor(x * 256).astype(np.int64)
    assert got == {int(i): highest(ids, whole, q, 5) for q, i in enumerate(ids) if i % 50 == 0}


@pytest.fixture
def clustered(spark):
    """Clusters, many equal vectors (ties), and rows that take no part."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 3
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16))
    x[500:1200] = x[500]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(5000, None), (5001, []), (5002, [1.0] * 15 + [None]), (5003, [1.0] * 15 + [float("nan")]), (5004, [float("inf")] * 16), (None, [1.0] * 16), (5005, [0.5] * 3), (7, rows[7][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("leaf", F.lit(1))
    return np.arange(3000), x, df


def test_neighbours_of_clusters_with_a_small_share(clustered):
    ids, x, df = clustered
    got = grouped(neighbours.nearest(df, F.col("vec_id") % 100 == 0, share=0.5, least=100, block=128).collect(), "vec_id")
    hits = [len(set(got[int(i)]) & set(nearest(ids, x, i, 10))) for i in ids if i % 100 == 0 and not 500 <= i < 1200]
    assert len(got) == 30 and np.mean(hits) >= 9
    whole = grouped(neighbours.nearest(df, F.col("vec_id") % 100 == 0, least=10**6, block=128).collect(), "vec_id")
    assert whole == {int(i): nearest(ids, x, i, 10) for i in ids if i % 100 == 0}


def test_top_lists_with_ties_and_small_blocks(clustered):
    ids, x, df = clustered
    whole = np.floor(x * 256).astype(np.int64)
    for block in (200, 16_384):
        got = grouped(topk.highest(df, F.col("vec_id") % 50 == 0, block=block, queries=7).collect(), "vec_id", "score")
        assert got == {int(i): highest(ids, whole, i, 5) for i in ids if i % 50 == 0}


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [0.5, 0.0]), (100, [0.0, -0.25]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    near = neighbours.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in near] == [(0, 1, 100), (100, 1, 0)]
    top = topk.highest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in top] == [(0, 3, 0), (0, 100, 0), (100, 0, 0), (100, 3, 0)]
    for none in (df.where("vec_id < 0"), df.where("vec_id = 3")):
        assert neighbours.nearest(none, F.col("vec_id") % 100 == 0).collect() == []
        assert topk.highest(none, F.col("vec_id") % 50 == 0).collect() == []
    assert neighbours.nearest(df, F.col("vec_id") < 0).collect() == [] and topk.highest(df, F.col("vec_id") < 0).collect() == []
