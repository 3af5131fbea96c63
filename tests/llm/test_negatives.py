"""Hard negatives against SQL and a literal search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from trialspark.llm import negatives
from trialspark.llm.queries import ORACLE, QUERIES


def brute(rows, is_anchor, positives=5, most=3):
    """rows: {vec_id: (label, vector)}."""
    whole = {i: (label, [int(np.floor(256 * x)) for x in v]) for i, (label, v) in rows.items()}
    out = []
    for a in filter(is_anchor, whole):
        scores = sorted((-sum(x * y for x, y in zip(whole[a][1], v, strict=True)), i) for i, (_, v) in whole.items() if i != a)
        for s, p in [(s, i) for s, i in scores if whole[i][0] == whole[a][0]][:positives]:
            fit = [(n, i) for n, i in scores if whole[i][0] != whole[a][0] and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(a, p, k, i, -s, -n) for k, (n, i) in enumerate(fit[:most], start=1)]
    return sorted(out)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_op13_equals_sql(spark, folder):
    path = f"/root/testdata/{folder}"
    message, rows, _ = differences(spark, connect(path), QUERIES["op13_negatives"], ORACLE["op13_negatives"], path)
    assert message is None and rows > 0


@pytest.fixture
def clustered(spark):
    """Clusters, equal vectors (ties), zero vectors, one label with half of the rows, and rows that take no part."""
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 8)) * 2
    x = centre[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8))
    x[100:160], x[200:210] = x[100], 0.0
    x[300:340] = -x[100]
    labels = np.where(rng.random(900) < 0.5, 3, rng.integers(0, 40, 900))
    rows = {i: (int(labels[i]), [float(c) for c in v]) for i, v in enumerate(x)}
    table = [(i, v, label) for i, (label, v) in rows.items()]
    bad = [(2000, None, 1), (2001, [], 1), (2050, [1.0] * 7 + [None], 1), (2003, [1.0] * 7 + [float("nan")], 1), (2100, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (2150, [0.5] * 3, 1), (50, rows[50][1], rows[50][0]), (2200, [1.0] * 8, None)]
    df = spark.createDataFrame(table + bad, "vec_id long, embedding array<double>, label int")
    return rows, df.withColumn("score", F.lit("x")).withColumn("ring", F.lit(1)).withColumn("q", F.lit(0))


@pytest.mark.parametrize(("block", "pack", "group"), [(16_384, 256, 4096), (100, 3, 5)])
def test_clusters_ties_and_small_blocks(clustered, block, pack, group):
    rows, df = clustered
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, clusters=6, block=block, pack=pack, group=group)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)


def test_walks_stop_early_on_clustered_anchors():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(40, 16))
    x = np.floor(256 * (np.repeat(centre, 100, axis=0) * 4 + rng.normal(size=(4000, 16)) * 0.3)).astype(np.int64)
    ids, labels = np.arange(4000), np.zeros(4000, np.int64)
    members = x[:20]
    shared = negatives.SharedList(ids, labels, x, members)
    low, high = np.full((20, 1), -(1 << 62)), np.full((20, 1), 1 << 62)
    row, _, item, score, walked = shared.walk(ids[:20], members, (low, high, lambda r, at: np.ones(len(r), bool)), 5)
    assert walked < 20 * 4000 / 4
    for m in range(20):
        all_scores = x @ members[m]
        want = [i for i in np.lexsort((ids, -all_scores)) if i != m][:5]
        assert item[row == m].tolist() == want and score[row == m].tolist() == all_scores[want].tolist()


def test_bounds_hold_for_every_member():
    rng = np.random.default_rng(5)
    x, members = (rng.integers(-300, 300, size=(n, 6)) for n in (500, 12))
    members[0] = 0
    shared = negatives.SharedList(np.arange(500), np.zeros(500), x, members)
    assert np.all(np.diff(shared.bound) <= 0)
    assert np.all(members @ shared.q.T <= np.sqrt((members.astype(float) ** 2).sum(1))[:, None] * shared.bound[None, :] + 1e-6)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = {i: (i % 2, [float(x) for x in rng.integers(-(10**6), 10**6, size=4)]) for i in range(60)}
    df = spark.createDataFrame([(i, v, label) for i, (label, v) in rows.items()], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 5 == 0).collect())) == brute(rows, lambda i: i % 5 == 0)


def test_few_or_no_rows(spark, clustered):
    _, df = clustered
    assert negatives.hard_negatives(df.where("vec_id < 0"), F.col("vec_id") % 50 == 0).collect() == []
    assert negatives.hard_negatives(df, F.col("vec_id") < 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], "vec_id long, embedding array<double>, label int")
    assert negatives.hard_negatives(alone, F.col("vec_id") == 0).collect() == []
