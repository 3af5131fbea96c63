"""Scoring, predicting and fitting hurdle models."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql
from trialspark.operators import draws, fitting
from trialspark.plans.oracle import statement

from .compare import connect


@pytest.fixture(scope="module")
def tables(spark):
    """Two participants, one of them without condition rows, 3,000 draws of one fit."""
    fit = {"experiment": "e", "bias_source": "cue", "model_name": "full"}
    ids = np.arange(3000)
    fixed = pd.DataFrame({**fit, "draw_id": ids, "b_intercept": 0.02 + ids % 7 / 1000, "b_stim": 0.5, "b_cond": 0.01, "b_stim_cond": 0.1,
                          "sigma": 0.03, "hu_intercept": 0.4, "hu_stim": -10.0, "hu_cond": -0.5, "hu_stim_cond": 1.0})
    random = pd.concat([pd.DataFrame({**fit, "draw_id": ids, "participant": p, "r_intercept": 0.001 * k, "r_cond": 0.002, "r_hu_intercept": 0.1 * k, "r_hu_cond": 0.05})
                        for k, p in enumerate(("001", "002"))])
    design = pd.DataFrame([("e", "001", "cue", "control", "low", 0.05), ("e", "001", "cue", "present", "low", 0.05), ("e", "002", "cue", "control", "absent", 0.0)],
                          columns=["experiment", "participant", "bias_source", "cond", "contrast_level", "stim"])
    return tuple(spark.createDataFrame(t) for t in (design, fixed, random))


def test_score(tables):
    scored = draws.score_draws(*tables)
    assert scored.count() == 3 * 3000
    r = scored.where("participant = '001' and cond = 'present' and draw_id = 8").first()
    assert r["mu"] == pytest.approx(0.021 + 0.5 * 0.05 + 0.01 + 0.1 * 0.05 + 0.002)
    assert r["hu"] == pytest.approx(1 / (1 + math.exp(-(0.4 - 10 * 0.05 - 0.5 + 1.0 * 0.05 + 0.05))))


def test_sampled_and_expected_predictions_agree(tables):
    scored = draws.score_draws(*tables)
    expected = {(r["participant"], r["cond"]): r for r in draws.predicted_cells(scored).collect()}
    sampled = {(r["participant"], r["cond"]): r for r in draws.sampled_cells(draws.predict_draws(draws.score_draws(draws.with_seed(tables[0], seed=2), *tables[1:]))).collect()}
    assert len(expected) == 3 and set(expected) == set(sampled)
    for key, e in expected.items():
        s = sampled[key]
        assert s["hurdle_prob"] == pytest.approx(e["hurdle_prob"], abs=0.04)
        assert s["response_pred"] == pytest.approx(e["response_pred"], abs=0.003)
        assert s["response_pred_non_zero"] == pytest.approx(e["response_pred_non_zero"], abs=0.004)


def test_conditional_draws(tables):
    """Mean `hu` and `mu` of the picks against the exact values under weights 1 - hu, also with few draws per cell."""
    design, fixed, random = tables
    for few, n, room in ((3000, 3000, 0.004), (60, 3000, 0.004), (40, 100, 0.03)):
        own = random.where(f"draw_id < {few}")
        scored = draws.score_draws(design, fixed, own)
        weight = 1 - F.col("hu")
        exact = scored.groupBy("participant", "cond").agg(*[(F.sum(weight * F.col(c)) / F.sum(weight)).alias(c) for c in ("hu", "mu")])
        exact = {(r["participant"], r["cond"]): r for r in exact.collect()}
        sample = draws.conditional_draws(design, fixed, own, n=n, seed=3)
        got = sample.groupBy("participant", "cond").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("hu", "mu", "pred")])
        assert got.count() == 3
        for r in draws.checked_size(got, n).collect():
            want = exact[r["participant"], r["cond"]]
            assert r["hu"] == pytest.approx(want["hu"], abs=room) and r["mu"] == pytest.approx(want["mu"], abs=room / 10)
            assert r["pred"] == pytest.approx(want["mu"], abs=room / 2)
    with pytest.raises(Exception, match="a cell has other than 101 rows"):
        draws.checked_size(got, 101).collect()


def test_conditional_draws_stay_where_they_are_scored(tables):
    """Draws and cells are shuffled, scored rows and picks are not: no window, and no exchange above the Python task."""
    plan = draws.conditional_draws(*tables, n=100, seed=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression") == 2
    assert plan.index("FlatMapCoGroupsInArrow") < plan.index("Join")


def test_conditional_draws_in_parts(spark, tables):
    """However the draws are dealt over parts and buckets, the same draws are picked; `again` tells repeated ones."""
    design, fixed, random = tables
    design = design.unionByName(spark.createDataFrame([("e", "002", "cue", None, "low", 0.1), ("e", "003", "cue", "control", "low", 0.1)], design.schema))
    whole = draws.conditional_draws(design, fixed, random, n=200, seed=3)
    rows = sorted(map(tuple, whole.drop("again").collect()))
    assert len(rows) == 3 * 200
    for options in ({"part_draws": 700}, {"bucket_draws": 500}, {"part_draws": 100, "bucket_picks": 50}):
        assert sorted(map(tuple, draws.conditional_draws(design, fixed, random, n=200, seed=3, **options).drop("again").collect())) == rows
    told = whole.groupBy(*draws.MODEL_CELL).agg(F.countDistinct("draw_id").alias("want"), F.count_if(~F.col("again")).alias("got"))
    assert told.where("want = got").count() == 3


def test_conditional_draws_without_chance(spark, tables):
    """Draws without a value, or which never pass, are not picked; a missing sigma makes the response missing."""
    design, fixed, random = tables
    odd = F.col("draw_id") % 3
    fixed = fixed.withColumn("hu_intercept", F.when(odd == 0, None).when(odd == 1, 900.0).otherwise(F.col("hu_intercept")))
    sample = draws.conditional_draws(design, fixed.withColumn("sigma", F.lit(None).cast("double")), random, n=50)
    assert sample.count() == 3 * 50 and sample.where("draw_id % 3 != 2 or pred is not null or mu is null").isEmpty()
    assert draws.conditional_draws(design, fixed.where(odd < 2), random, n=50).count() == 0
    assert draws.conditional_draws(design, fixed, random.where("false"), n=50).count() == 0


def test_conditional_sums_equal_the_picks(spark, tables):
    """Whole and in parts; unknown responses are left out of the mean alone."""
    design, fixed, random = tables
    fixed = fixed.withColumn("sigma", F.when(F.col("draw_id") % 5 > 0, F.col("sigma")))
    picks = draws.conditional_draws(design, fixed, random, n=60, seed=3).groupBy(*draws.MODEL_CELL)
    want = picks.agg(F.count(F.lit(1)), F.count_if(~F.col("again")), F.count("pred"), F.sum("pred"), F.sum("hu")).toPandas()
    for options in ({}, {"part_draws": 7, "bucket_draws": 10}):
        sums = draws.conditional_sums(design, fixed, random, n=60, seed=3, **options).groupBy(*draws.MODEL_CELL).sum("n", "n_draws", "n_pred", "pred_sum", "hu_sum")
        got = sums.toPandas().sort_values(draws.MODEL_CELL)
        ordered = want.sort_values(draws.MODEL_CELL)
        assert len(got) and got[draws.MODEL_CELL].to_numpy().tolist() == ordered[draws.MODEL_CELL].to_numpy().tolist()
        assert (got.iloc[:, -5:-2].to_numpy() == ordered.iloc[:, -5:-2].to_numpy()).all()
        assert np.allclose(got.iloc[:, -2:].to_numpy(float), ordered.iloc[:, -2:].to_numpy(float), rtol=1e-9)


def test_loglik(spark):
    df = spark.createDataFrame([("k", 0.0, 0.1, 0.2, 0.3), ("k", 0.25, 0.1, 0.2, 0.3), ("k", None, 0.1, 0.2, 0.3)], "k string, response double, mu double, sigma double, hu double")
    r = draws.hurdle_loglik(df, ["k"]).first()
    normal = -0.5 * (0.15 / 0.2) ** 2 - math.log(0.2) - 0.5 * math.log(2 * math.pi)
    assert (r["loglik"], r["n"]) == (pytest.approx(math.log(0.3) + math.log(0.7) + normal), 2)


def dense_fit(table, with_cond, ridge):
    """All coefficients of one part at once: Newton steps on the full matrix."""
    s, c = table.stim.to_numpy(), (table.cond == "present").to_numpy(float)
    people = pd.get_dummies(table.participant).to_numpy(float)
    common = [np.ones_like(s), s] + ([c, s * c] if with_cond else [])
    own = [people] + ([people * c[:, None]] if with_cond else [])
    x = np.column_stack([*common, *own])
    penalty = np.diag([0.0] * len(common) + [ridge] * (x.shape[1] - len(common)))
    zero = (table.response == 0).to_numpy(float)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        hessian = x.T @ (x * (p * (1 - p))[:, None]) + penalty
        beta = beta + np.linalg.lstsq(hessian, x.T @ (zero - p) - penalty @ beta, rcond=None)[0]
    p = 1 / (1 + np.exp(-x @ beta))
    loglik = np.sum(zero * np.log(p) + (1 - zero) * np.log(1 - p))
    y, xp = table.response[zero == 0].to_numpy(), x[zero == 0]
    gamma = np.linalg.lstsq(xp.T @ xp + penalty, xp.T @ y, rcond=None)[0]
    variance = np.mean((y - xp @ gamma) ** 2)
    return beta[: len(common)], gamma[: len(common)], loglik - len(y) / 2 * (math.log(2 * math.pi * variance) + 1), math.sqrt(variance)


def test_fit_equals_dense_fit(spark):
    rng = np.random.default_rng(11)
    rows = []
    for group, source in enumerate(("cue", "payoff")):
        for person in range(6):
            for k in range(80):
                cond, stim = ("control", "present")[k % 2], (0.0, 0.03, 0.06)[k % 3] + person / 1000
                eta = 0.8 - 30 * stim - (0.8 if cond == "present" and group else 0) + person / 10
                passed = rng.random() > 1 / (1 + math.exp(-eta))
                rows.append(("exp1", f"{person:03}", source, cond, "low", stim, float(0.05 + stim + rng.normal() * 0.02) if passed else 0.0))
    table = pd.DataFrame(rows, columns=["experiment", "participant", "bias_source", "cond", "contrast_level", "stim", "response"])
    frame = spark.createDataFrame(table)
    fixed = {"ridge": 0.7, "tol": 1e-9, "prior_people": None, "evidence": "bic"}
    fits = fitting.fit_hurdle(frame, **fixed).toPandas().set_index(["bias_source", "model_name"])
    assert fits.converged.all() and (fits.iterations > 2).all()
    unsettled = fitting.fit_hurdle(frame, max_iter=2, **fixed)
    assert {(r["converged"], r["iterations"]) for r in unsettled.collect()} == {(False, 2)}
    assert len(fits) == 8
    for source in ("cue", "payoff"):
        for model, with_cond in (("simple", False), ("full", True)):
            beta, gamma, loglik, sigma = dense_fit(table[table.bias_source == source], with_cond, 0.7)
            got = fits.loc[(source, model)]
            size = len(beta)
            assert got[["hu_intercept", "hu_stim", "hu_cond", "hu_stim_cond"]].to_numpy(float)[:size] == pytest.approx(beta, abs=1e-5)
            assert got[["b_intercept", "b_stim", "b_cond", "b_stim_cond"]].to_numpy(float)[:size] == pytest.approx(gamma, abs=1e-7)
            assert (got["loglik"], got["sigma"]) == (pytest.approx(loglik, abs=1e-4), pytest.approx(sigma))
    assert fits.loc[("payoff", "hurdle"), "hu_cond"] < 0 and (fits["df"] > 5).all()
    for source in ("cue", "payoff"):
        f = fits.loc[source]
        assert f.loc["full", "logml"] - f.loc["simple", "logml"] == pytest.approx(
            f.loc["contrast", "logml"] + f.loc["hurdle", "logml"] - 2 * f.loc["simple", "logml"], abs=1e-6)


def dense_covariance_fit(table, with_cond, kind, rounds=150, prior_people=2.0):
    """One part with all coefficients in one system, expectation-maximisation for the participants' covariance: common
    coefficients, covariance, residual variance, log determinant of the negative Hessian, Laplace evidence."""
    table = table if kind == "hu" else table[table.response != 0]
    s, c = table.stim.to_numpy(), (table.cond == "present").to_numpy(float)
    people = pd.get_dummies(table.participant).to_numpy(float)
    common = [np.ones_like(s), s] + ([c, s * c] if with_cond else [])
    x = np.column_stack([*common, people] + ([people * c[:, None]] if with_cond else []))
    d, k, own = len(common), people.shape[1], 1 + with_cond
    zero, y = (table.response == 0).to_numpy(float), table.response.to_numpy()
    beta, t, s2, used = np.zeros(x.shape[1]), np.eye(own), 1.0, 0.0
    for _ in range(rounds):
        eta = x @ beta
        if kind == "hu":
            p = 1 / (1 + np.exp(-eta))
            weight = p * (1 - p)
            target = eta + (zero - p) / weight
        else:
            weight, target = np.ones(len(y)), y
            s2 = (np.sum((y - eta) ** 2) + s2 * used) / len(y)
        penalty = np.zeros((x.shape[1],) * 2)
        penalty[d:, d:] = np.kron(np.linalg.inv(t), np.eye(k))
        hessian = x.T @ (x * weight[:, None]) + penalty
        beta = np.linalg.solve(hessian, x.T @ (weight * target))
        v = np.linalg.inv(hessian[d:, d:])
        u = beta[d:].reshape(own, k)
        apart = np.array([[np.trace(v[i * k : i * k + k, j * k : j * k + k]) for j in range(own)] for i in range(own)])
        used = k * own - np.trace(v @ penalty[d:, d:])
        before, t = t, (u @ u.T / s2 + apart + prior_people * np.eye(own)) / (k + prior_people)
    logdet = np.linalg.slogdet(hessian / s2)[1]
    eta = x @ beta
    if kind == "hu":
        loglik = np.sum(zero * eta - np.logaddexp(0, eta))
    else:
        loglik = -len(y) / 2 * math.log(2 * math.pi * s2) - np.sum((y - eta) ** 2) / (2 * s2)
    # The normal prior of the effects and the integral over them; the common coefficients cost half a log n each.
    prior = -k * own / 2 * math.log(2 * math.pi) - k / 2 * np.linalg.slogdet(s2 * before)[1] - beta[d:] @ penalty[d:, d:] @ beta[d:] / s2 / 2
    inside = k * own / 2 * math.log(2 * math.pi) - np.linalg.slogdet(hessian[d:, d:] / s2)[1] / 2
    return beta[:d], before * s2, logdet, loglik + prior + inside - d / 2 * math.log(len(y))


def agrees_with_dense(got, rows, with_cond, room):
    """A row of fits of the simple or the full model against the dense fits of both parts."""
    logdet, logml = 0.0, 0.0
    for kind, prefix, first in (("hu", "hu_", "hu_"), ("mu", "", "b_")):
        beta, spread, det, evidence = dense_covariance_fit(rows, with_cond, kind)
        names = [f"{first}{x}" for x in ("intercept", "stim", "cond", "stim_cond")]
        assert got[names].to_numpy(float)[: len(beta)] == pytest.approx(beta, rel=room, abs=room)
        sd = np.sqrt(np.diag(spread))
        assert got[f"{prefix}sd_intercept"] == pytest.approx(sd[0], rel=room)
        if with_cond:
            assert got[f"{prefix}sd_cond"] == pytest.approx(sd[1], rel=room)
            assert got[f"{prefix}cor"] == pytest.approx(spread[0, 1] / sd[0] / sd[1], abs=room)
        logdet, logml = logdet + det, logml + evidence
    assert (got["logdet"], got["logml"]) == (pytest.approx(logdet, rel=room), pytest.approx(logml, rel=room))


def test_covariance_and_evidence_equal_dense_fit(spark):
    rng = np.random.default_rng(12)
    rows = []
    for person in range(14):
        low, high = rng.multivariate_normal([0, 0], [[0.6, -0.4], [-0.4, 0.8]]), rng.normal(size=2) * [0.02, 0.01]
        for k in range(60):
            cond, stim = ("control", "present")[k % 2], (0.0, 0.03, 0.06)[k % 3] + person / 1000
            c = float(cond == "present")
            passed = rng.random() > 1 / (1 + math.exp(-(0.5 - 15 * stim - 0.6 * c + low[0] + low[1] * c)))
            rows.append(("exp1", f"{person:03}", "cue", cond, "low", stim, float(0.08 + stim + high[0] + high[1] * c + rng.normal() * 0.02) if passed else 0.0))
    table = pd.DataFrame(rows, columns=["experiment", "participant", "bias_source", "cond", "contrast_level", "stim", "response"])
    fits = fitting.fit_hurdle(spark.createDataFrame(table), tol=1e-6).toPandas().set_index("model_name")
    assert fits.converged.all() and len(fits) == 4
    for model, with_cond in (("simple", False), ("full", True)):
        agrees_with_dense(fits.loc[model], table, with_cond, 5e-3)
    # The evidence of both parts adds up.
    assert fits.logml["full"] - fits.logml["contrast"] == pytest.approx(fits.logml["hurdle"] - fits.logml["simple"], abs=1e-6)


def test_fit_in_sql_equals_dense_fit():
    db = connect("/root/testdata/sf0.01")
    table = db.execute(statement("SELECT experiment, participant, bias_source, cond, stim, response FROM mframe WHERE response IS NOT NULL")).df()
    fits = db.execute(oracle_sql()["hurdle_fit"]).df().set_index(["experiment", "bias_source", "model_name"])
    groups = list(table.groupby(["experiment", "bias_source"]))
    assert len(fits) == 4 * len(groups) and fits.converged.all()
    for key, rows in groups[:3]:
        for model, with_cond in (("simple", False), ("full", True)):
            agrees_with_dense(fits.loc[(*key, model)], rows, with_cond, 0.02)


def test_participants_of_a_fit_are_not_broadcast(spark, monkeypatch):
    """However few they are: the broadcasts of all iterations would add up in the driver. Rows of fits may be."""
    rows = [("exp1", f"{k % 4:03}" if k % 4 else None, "cue", ("control", "present")[k % 2], "low", 0.02 + k % 3 / 50, (k % 5) / 20.0) for k in range(240)]
    table = spark.createDataFrame(rows, "experiment string, participant string, bias_source string, cond string, contrast_level string, stim double, response double")
    plans, stored = [], fitting._stored

    def recorded(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df)

    monkeypatch.setattr(fitting, "_stored", recorded)
    assert fitting.fit_hurdle(table, max_iter=3).count() == 4
    later = plans[-2:]
    assert all("u_intercept" in p and p.count("SortMergeJoin") >= 1 for p in later)
    monkeypatch.undo()
    effects, _ = fitting.fit_parts(stored(fitting._numbered(fitting.hurdle_cells(table))), max_iter=2)
    assert effects.count() == 4 * 4 and effects.where("participant IS NULL").count() == 4
