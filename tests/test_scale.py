"""Ways taken for large or uneven data give the same rows, and plans keep their shape."""

import contextlib
import functools
import io

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialspark.operators import draws, exclude, fitting, joins, ranking, summarise
from trialspark.plans import fixtures, registry
from trialspark.plans.registry import QUERIES


def plan(df, mode="formatted"):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode)
    return text.getvalue()


@pytest.fixture
def many_partitions(spark):
    """Adaptive execution would merge small partitions and hide the large-data path."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture
def uneven(spark):
    """One key holds most rows, with many ties; another is missing."""
    rng = np.random.default_rng(1)
    table = pd.DataFrame({"k": np.where(rng.random(6000) < 0.7, "hot", rng.choice(["a", "b", "c"], 6000)), "v": rng.integers(0, 900, 6000) / 8})
    table.loc[table.k == "c", "k"] = None
    table.loc[::97, "v"] = None
    return table, spark.createDataFrame(table.astype(object).where(table.notna(), None), "k string, v double")


def test_ranks_across_partitions(many_partitions, uneven):
    table, df = uneven
    counts = ranking.ordered_counts(df.repartition(5), ["k"], "v", part_rows=100)
    got = counts.select("k", "v", ranking.avg_rank().alias("rank"), "total").toPandas()
    known = table[table.v.notna()].copy()
    known["k"] = known.k.fillna("-")
    known["rank"] = known.groupby("k").v.rank()
    want = known.drop_duplicates(["k", "v"])
    merged = got.fillna({"k": "-"}).merge(want, on=["k", "v"], suffixes=("", "_want"))
    assert len(merged) == len(got) == len(want)
    assert (merged["rank"] == merged["rank_want"]).all()
    assert (merged.total == merged.k.map(known.k.value_counts())).all()


def test_a_large_key_spans_parts(uneven):
    _, df = uneven
    placed = ranking.place_values(df, ["k"], "v", part_rows=100)
    parts = {r["k"]: r["n"] for r in placed.groupBy("_group.k").agg(F.countDistinct("_part").alias("n")).collect()}
    assert parts["hot"] > 5
    assert ranking.place_values(df, ["k"], "v").select("_part").distinct().count() == 1


def test_exact_median(many_partitions, uneven):
    table, df = uneven
    got = {r["k"]: r["median"] for r in ranking.exact_median(df, ["k"], "v", part_rows=100).collect()}
    known = table.assign(k=table.k.fillna("-")).groupby("k").v.median()
    assert {k or "-": v for k, v in got.items()} == known.to_dict()


def test_lookup_without_broadcast(spark, uneven):
    _, df = uneven
    means = df.groupBy("k").agg(F.avg("v").alias("m"))
    small, large = (joins.lookup_join(df, means, ["k"], max_rows=n) for n in (100, 0))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert small.count() == df.count()
    assert "BroadcastHashJoin" in plan(small)


def test_salted_join_keeps_all_rows(spark):
    many = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, "hot").otherwise("cold"))
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3)], "k string, x int")
    got = joins.salted_join(many, few, ["k"], ["id"], heavy_rows=200)
    assert got.count() == 900 * 2 + 100
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(few, "k").select(*got.columns).collect()))


def test_top_n_is_cut_before_the_shuffle(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 3)
    picked = draws.sample_per_group(rows, ["k"], 5, ["id"], seed=2)
    text = plan(picked, "simple")
    assert text.index("Exchange") > text.index("WindowGroupLimit") and text.count("WindowGroupLimit") == 2
    first = sorted(map(tuple, picked.collect()))
    assert len(first) == 15
    again = draws.sample_per_group(rows.repartition(9), ["k"], 5, ["id"], seed=2)
    assert sorted(map(tuple, again.collect())) == first


def test_scans_read_needed_columns_only(spark, small_dir):
    text = plan(summarise.proportion_present(fixtures.trials(spark, small_dir)))
    schema = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "props" not in schema and "ts:" not in schema


def test_statistics_read_the_trials_once(spark, small_dir):
    text = plan(exclude.trial_statistics(fixtures.trials(spark, small_dir)), "simple")
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


@pytest.mark.parametrize("name", ["predict_expected", "paired_effect_size", "signed_rank", "observed_effect", "key_grid", "source_labels", "model_bf"])
def test_no_cross_joins(spark, small_dir, name):
    text = plan(QUERIES[name](spark, small_dir), "simple")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_partial_aggregation_before_the_only_shuffle(spark, small_dir):
    text = plan(summarise.mean_nonzero(fixtures.trials(spark, small_dir)), "simple")
    assert "partial_avg" in text and text.count("Exchange") == 1


def test_only_heavy_keys_are_salted(spark):
    many = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, "hot").otherwise("cold"))
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("cold", 3)], "k string, x int")
    assert "_salt" in plan(joins.salted_join(many, few, ["k"], ["id"], heavy_rows=200), "simple")
    assert "_salt" not in plan(joins.salted_join(many, few, ["k"], ["id"]), "simple")


def test_a_large_top_n_is_cut_per_salted_key(spark):
    """From n = 1000 on Spark cuts nothing itself; the rows of a hot key must not meet in one task uncut."""
    rows = spark.range(200_000).withColumn("k", F.when(F.col("id") < 190_000, 0).otherwise(F.col("id") % 3))
    picked = draws.sample_per_group(rows, ["k"], 1500, ["id"], seed=2)
    text = plan(picked, "simple")
    assert text.count("Window ") == 2 and "_salt" in text
    got = {r["k"]: r["count"] for r in picked.groupBy("k").count().collect()}
    assert got == {0: 1500, 1: 1500, 2: 1500}
    want = rows.withColumn("h", F.md5(F.concat_ws("|", F.lit("2"), F.lit("sample"), F.col("id").cast("string")).cast("binary"))).where("k = 0").orderBy("h", "id").limit(1500)
    assert picked.where("k = 0").join(want, "id", "left_anti").count() == 0


def test_picks_of_one_model_alone(spark, small_dir):
    """The draws of a model are picked the same with and without those of the other models."""
    alone, all_models = (registry._conditional(spark, small_dir, model).where("model_name = 'full'") for model in ("full", None))
    rows = sorted(map(str, alone.collect()))
    assert rows and rows == sorted(map(str, all_models.collect()))


@pytest.mark.parametrize("name", ["conditional_draws", "predicted_nonzero_means", "perceived_contrast_effect", "perceived_vs_observed_effect"])
def test_no_pick_leaves_its_task(spark, small_dir, name):
    """What comes out of the Python step is a row per cell, not one per pick."""
    text = plan(QUERIES[name](spark, small_dir), "simple")
    assert "pred_sum" in text and "pick#" not in text


def rows_broadcast(df):
    """Rows of each broadcast in the plan by which `df` ran."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "BroadcastExchange":
            found.append(node.longMetric("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


@pytest.mark.parametrize("name", ["hurdle_fit", "hurdle_fit_evidence"])
def test_only_rows_of_fits_pass_the_driver(spark, small_dir, monkeypatch, name):
    """What a fit broadcasts, in whatever iteration, has a row per fit and none per participant."""
    people = fixtures.trials(spark, small_dir).select(*fitting.PARTICIPANT).distinct()
    fits = 4 * people.select(*fitting.GROUP).distinct().count()
    assert 4 * people.count() > fits
    sent, stored = [], fitting._stored
    monkeypatch.setattr(fitting, "_stored", lambda df: (sent.append(rows_broadcast(df)), stored(df))[1])
    monkeypatch.setattr(fitting, "fit_hurdle", functools.partial(fitting.fit_hurdle, max_iter=2))
    sent.append(rows_broadcast(QUERIES[name](spark, small_dir)))
    assert any(sent) and max(sum(sent, [])) <= fits
