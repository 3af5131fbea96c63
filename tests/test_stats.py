"""Statistics against direct computation."""

import math
from itertools import product
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialspark.operators import compare, diagnostics, effects, models, regression, summarise


def brute_log_bf(t, n, r):
    """Plain double sum over effect and scale on a fine grid."""
    nu = n - 1
    y = np.linspace(1e-6, math.sqrt(nu) + 14, 3000)
    log_w = nu * np.log(y) - y**2 / 2
    w = np.exp(log_w - log_w.max())
    a = t * y / math.sqrt(nu)
    theta = (np.arange(4000) + 0.5) / 4000 * (-math.pi / 2)
    mu = math.sqrt(n) * r * np.tan(theta)
    top = (w[None, :] * np.exp(-((a[None, :] - mu[:, None]) ** 2) / 2)).sum() / 4000 * (math.pi / 2)
    return math.log(2 / math.pi * top / (w * np.exp(-(a**2) / 2)).sum())


def log_bf(spark, cases, r=0.707):
    rows = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(cases)], "i int, t double, n long")
    return [x[0] for x in rows.orderBy("i").select(compare.log_bf_negative(r)("t", "n")).collect()]


def test_one_sided_bayes_factor(spark):
    # One-sided factors known for (t, n).
    known = {(-2.5, 57): 4.90090, (1.0, 20): 0.128079, (-8.0, 105): 8.62436e9}
    for got, want in zip(log_bf(spark, list(known)), known.values()):
        assert math.exp(got) == pytest.approx(want, rel=2e-5)
    cases = [(0.0, 2), (-1.5, 2), (2.0, 5), (-3.0, 40), (6.0, 60), (0.4, 300)]
    for got, (t, n) in zip(log_bf(spark, cases), cases):
        assert got == pytest.approx(brute_log_bf(t, n, 0.707), abs=2e-5)


def test_bayes_factor_of_huge_samples(spark):
    near, far = log_bf(spark, [(-3.0, 10**6), (-3.0, 10**8)])
    # The likelihood narrows with the sample while the prior stays: the factor falls with the square root of n.
    assert near - far == pytest.approx(math.log(10), abs=0.01)
    missing = spark.createDataFrame([(None, 5), (1.0, 1)], "t double, n long")
    assert [r[0] for r in missing.select(compare.log_bf_negative(0.707)("t", "n")).collect()] == [None, None]


def test_pairs_drop_incomplete_and_keep_signs(spark):
    rows = [("e", str(p), "cue", d, "low", v) for p, c, b in [(1, 0.1, 0.3), (2, 0.2, 0.3), (3, 0.2, None), (4, 0.3, 0.6)] for d, v in [("control", c), ("present", b)]]
    df = spark.createDataFrame(rows, "experiment string, participant string, bias_source string, bias_direction string, contrast_level string, value double")
    r = compare.paired_bf(df).first()
    diff = np.array([0.2, 0.1, 0.3])
    assert (r["n_pairs"], r["n_dropped"]) == (3, 1)
    assert r["d"] == pytest.approx(diff.mean() / diff.std(ddof=1))
    assert r["t"] == pytest.approx(-diff.mean() / diff.std(ddof=1) * math.sqrt(3))
    assert r["log_bf"] > 0
    constant = df.withColumn("value", F.when(F.col("bias_direction") == "present", 0.25).otherwise(0.125))
    assert compare.paired_bf(constant).first()["log_bf"] is None


def numpy_rhat(chains):
    n = chains.shape[1]
    within, between = chains.var(axis=1, ddof=1).mean(), n * chains.mean(axis=1).var(ddof=1)
    return math.sqrt(((n - 1) / n * within + between / n) / within)


def test_rhat(spark):
    rng = np.random.default_rng(5)
    draws = rng.normal(size=(4, 41)) + np.arange(4)[:, None] * 0.3
    draws[2, 5] = draws[1, 7]
    rows = [("e", "c", "m", "x", k + 1, i + 1, float(draws[k, i])) for k in range(4) for i in range(41)]
    rows += [("e", "c", "m", "constant", k, i, 1.0) for k in (1, 2) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "experiment string, condition string, model_name string, parameter string, chain int, iteration long, value double")
    split = np.concatenate([draws[:, :20], draws[:, 21:]])  # the middle draw of an odd length is left out

    def normalised(x):
        rank = pd.Series(x.ravel()).rank().to_numpy()
        return np.array([NormalDist().inv_cdf((r - 0.375) / (x.size + 0.25)) for r in rank]).reshape(x.shape)

    plain = {r["parameter"]: r["rhat"] for r in diagnostics.rhat(df, rank=False).collect()}
    ranked = {r["parameter"]: r["rhat"] for r in diagnostics.rhat(df).collect()}
    assert plain["x"] == pytest.approx(numpy_rhat(split)) and plain["constant"] is None
    folded = np.abs(split - np.median(split))
    assert ranked["x"] == pytest.approx(max(numpy_rhat(normalised(split)), numpy_rhat(normalised(folded))))
    assert ranked["constant"] is None
    # A warm-up offset and thinning change the numbers of the iterations, not the result.
    moved = df.withColumn("iteration", 1000 + 3 * F.col("iteration"))
    for rank, want in ((False, plain), (True, ranked)):
        got = {r["parameter"]: r["rhat"] for r in diagnostics.rhat(moved, rank=rank).collect()}
        assert got["x"] == pytest.approx(want["x"]) and got["constant"] is None
    drifting = spark.createDataFrame([("e", "c", "m", "x", k, i, i / 10 + (i * 7 % 5) + k / 100) for k in (1, 2) for i in range(1001, 1101)], df.schema)
    assert diagnostics.rhat(drifting, rank=False).first()["rhat"] > 1.5
    holey = df.withColumn("value", F.when((F.col("chain") == 2) & (F.col("iteration") == 3), None).otherwise(F.col("value")))
    assert [r["rhat"] for r in diagnostics.rhat(holey).collect()] == [None, None]


def test_rhat_needs_equal_regular_chains(spark):
    rows = [("e", "c", "m", "short", k, i, float(i * k % 7)) for k in (1, 2) for i in range(1, 101) if k == 1 or i <= 10]
    schema = "experiment string, condition string, model_name string, parameter string, chain int, iteration long, value double"
    with pytest.raises(Exception, match="short"):
        diagnostics.rhat(spark.createDataFrame(rows, schema), rank=False).collect()
    gap = [("e", "c", "m", "gap", k, i + (i > 5), float(i * k % 7)) for k in (1, 2) for i in range(1, 11)]
    with pytest.raises(Exception, match="gap"):
        diagnostics.rhat(spark.createDataFrame(gap, schema)).collect()


def test_gate_and_trace(spark):
    values = spark.createDataFrame([("e", "c", "m", "a", 1.0), ("e", "c", "m", "b", 1.03), ("e", "c", "m", "k", None), ("e", "c", "n", "a", 1.005)],
                                   "experiment string, condition string, model_name string, parameter string, rhat double")
    got = {r["model_name"]: (r["n_parameters"], r["n_high"], r["passed"]) for r in diagnostics.rhat_gate(values).collect()}
    assert got == {"m": (3, 1, False), "n": (1, 0, True)}
    assert [r["parameter"] for r in diagnostics.high_rhat(values).collect()] == ["b"]
    draws = spark.createDataFrame([("a", i) for i in range(1, 11)] + [("b", 5)], "parameter string, iteration int")
    assert [r["iteration"] for r in diagnostics.trace(draws, ["a"], every=5).collect()] == [5, 10]
    odds = diagnostics.evidence_ratio(spark.createDataFrame([("k", x) for x in (1.0, 2.0, -1.0, 0.0)], "k string, value double"), ["k"])
    assert odds.first()["evidence_ratio"] == 2.0


# Published log Bayes factors over the simple model and of hurdle over contrast.
EVIDENCE = {
    ("exp1", "baserate"): (266.706, 1400.633, 1667.304, 1133.888),
    ("exp1", "cue"): (1112.885, 425.245, 1538.240, -687.750),
    ("exp1", "payoff"): (94.564, 263.526, 358.085, 168.884),
    ("exp2", "baserate"): (297.644, 473.294, 771.059, 175.751),
    ("exp2", "cue"): (354.252, 307.059, 661.224, -47.151),
    ("exp2", "payoff"): (47.879, 259.776, 307.580, 211.898),
}


def test_published_evidence(spark):
    rows = [(e, c, m, v) for (e, c), values in EVIDENCE.items() for m, v in zip(("simple", "contrast", "hurdle", "full"), (0.0, *values[:3]))]
    bf = models.model_bf(spark.createDataFrame(rows, "experiment string, condition string, model string, logml double"))
    assert bf.count() == 6 * 6
    for r in models.rebase(bf, "contrast").where("model = 'hurdle'").collect():
        assert r["bf_log"] == pytest.approx(EVIDENCE[(r["experiment"], r["condition"])][3], abs=0.2)
    favoured = {(r["experiment"], r["condition"]): r["evidence"] for r in models.evidence(bf).collect()}
    assert favoured == {k: "contrast" if k[1] == "cue" else "hurdle" for k in EVIDENCE}
    best = models.against_baseline(bf)
    assert {r["model"] for r in best.collect()} == {"contrast", "hurdle", "full"}
    for (contrast, hurdle, full, _) in EVIDENCE.values():
        assert full == pytest.approx(contrast + hurdle, abs=0.2)


def test_regression_with_and_without_participants(spark):
    rng = np.random.default_rng(3)
    table = pd.DataFrame({"experiment": "e", "bias_source": "cue", "participant": np.repeat([f"{i}" for i in range(12)], 3)})
    table["answer"] = rng.normal(size=36)
    table["hurdle_prob"] = 0.5 * table.answer + np.repeat(rng.normal(size=12), 3) + rng.normal(size=36) * 0.1
    df = spark.createDataFrame(table)
    plain, within = regression.effect_regression(df).first(), regression.effect_regression(df, within=True).first()
    slope, intercept = np.polyfit(table.answer, table.hurdle_prob, 1)
    assert (plain["slope"], plain["intercept"]) == pytest.approx((slope, intercept))
    assert plain["r2"] == pytest.approx(np.corrcoef(table.answer, table.hurdle_prob)[0, 1] ** 2)
    design = np.column_stack([table.answer, pd.get_dummies(table.participant).to_numpy(float)])
    beta, rss, *_ = np.linalg.lstsq(design, table.hurdle_prob, rcond=None)
    assert within["slope"] == pytest.approx(beta[0]) and within["df"] == 36 - 13
    assert within["sigma"] == pytest.approx(math.sqrt(rss[0] / 23))
    line = regression.regression_line(df, regression.effect_regression(df)).toPandas()
    assert len(line) == 36 and (line.ymin < line.y).all() and np.allclose(line.y, intercept + slope * line.x)
    assert regression.slope_evidence(regression.effect_regression(df)).first()["evidence_ratio"] > 1


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", None), ("b", 3.0)], "k string, v double")
    x = np.array([1.0, 2.0, 4.0])
    se = x.std(ddof=1) / math.sqrt(3)
    got = {r["k"]: r for r in summarise.mean_se(df, ["k"], "v").collect()}
    assert (got["a"]["y"], got["a"]["ymin"], got["a"]["ymax"]) == pytest.approx((x.mean(), x.mean() - se, x.mean() + se))
    assert got["b"]["ymin"] is None
    wide = {r["k"]: r for r in summarise.mean_ci(df, ["k"], "v").collect()}
    assert wide["a"]["ymax"] == pytest.approx(x.mean() + 4.302652729749462 * se) and wide["b"]["ymax"] is None


def test_signed_rank(spark):
    diffs = [3, -1, 4, -1, 5, 9, -2, 6, 0]
    rows = [("e", str(i), "cue", d, "low", float(v)) for i, x in enumerate(diffs) for d, v in (("control", x), ("present", 0))]
    df = spark.createDataFrame(rows, "experiment string, participant string, bias_source string, bias_direction string, contrast_level string, value double")
    flat = df.withColumn("bias_source", F.lit("payoff")).withColumn("value", F.lit(1.0))
    half = df.where("bias_direction = 'control'").withColumn("bias_source", F.lit("baserate"))
    by_source = {r["bias_source"]: r for r in compare.signed_rank(df.unionByName(flat).unionByName(half)).collect()}
    for source, zero, dropped in (("payoff", 9, 0), ("baserate", 0, 9)):
        r = by_source[source]
        assert (r["n_pairs"], r["n_zero"], r["n_dropped"], r["w_plus"], r["z"]) == (0, zero, dropped, 0, None)
        assert (r["p_less"], r["p_greater"], r["exact"]) == (1, 1, True)
    r = by_source["cue"]
    assert (r["n_zero"], r["n_dropped"]) == (1, 0)
    ranks = pd.Series([abs(x) for x in diffs if x]).rank()
    plus = sum(k for k, x in zip(ranks, [x for x in diffs if x]) if x > 0)
    assert (r["n_pairs"], r["w_plus"], r["w_minus"]) == (8, plus, 36 - plus)
    assert r["z"] == pytest.approx((plus - 18) / math.sqrt(8 * 9 * 17 / 24 - (2**3 - 2) / 48))
    # All ways to sign eight differences.
    all_sums = [sum(k for k, s in zip(ranks, signs) if s) for signs in product((0, 1), repeat=8)]
    assert r["exact"] and r["p_less"] == pytest.approx(sum(x <= plus for x in all_sums) / 256)
    assert r["p_greater"] == pytest.approx(sum(x >= plus for x in all_sums) / 256)
    beyond = {r["bias_source"]: r for r in compare.signed_rank(df, exact_pairs=7).collect()}["cue"]
    assert not beyond["exact"] and beyond["p_less"] == pytest.approx(NormalDist().cdf(r["z"]), abs=1e-7)


def test_signed_rank_tails_of_many_pairs(spark):
    """Fifty ranks without ties against the counts of subsets by their sum."""
    ways = {0: 1}
    for k in range(1, 51):
        after = dict(ways)
        for total, number in ways.items():
            after[total + k] = after.get(total + k, 0) + number
        ways = after
    less, greater = compare.signed_rank_tails("transform(sequence(1, 50), k -> 2 * k)", "2 * w")
    sums = (0, 300, 637, 638, 1275)
    got = {r["w"]: r for r in spark.createDataFrame([(w,) for w in sums], "w int").select("w", less.alias("p"), greater.alias("q")).collect()}
    for w in sums:
        assert got[w]["p"] == pytest.approx(sum(x for t, x in ways.items() if t <= w) / 2**50)
        assert got[w]["q"] == pytest.approx(sum(x for t, x in ways.items() if t >= w) / 2**50)


def test_effect_table_pairs_within_the_unit(spark):
    rows = [("e", "cue", p, c, v) for p, c, v in [("1", "control", 0.1), ("1", "present", 0.4), ("2", "control", 0.2), ("2", "present", 0.3), ("3", "control", 0.9)]]
    df = spark.createDataFrame(rows, "experiment string, bias_source string, participant string, cond string, v double")
    r = effects.effect_table(df, "v", ["experiment", "bias_source", "participant"], ["experiment", "bias_source"]).first()
    assert r["n"] == 2 and r["y"] == pytest.approx(0.2)
