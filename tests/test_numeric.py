import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from trialspark.functions import numeric, student, text

NORMAL = NormalDist()


def values(spark, xs, expression, kind="double"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression("x").alias("y")).collect()]


def test_qnorm(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.0749, 0.0751, 0.2, 0.5, 0.7, 0.9249, 0.9251, 0.999, 1 - 1e-12]
    for p, got in zip(ps, values(spark, ps, numeric.qnorm)):
        assert got == pytest.approx(NORMAL.inv_cdf(p), rel=1e-13, abs=1e-15)
    assert values(spark, [0.0, 1.0, -0.1, 1.1, None], numeric.qnorm) == [-math.inf, math.inf, None, None, None]


def test_normal_cdf(spark):
    xs = [-40.0, -9.0, -7.1, -7.0, -2.5, -0.1, 0.0, 0.3, 1.96, 7.0, 7.2, 38.0]
    for x, got in zip(xs, values(spark, xs, numeric.normal_cdf)):
        assert got == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-7, abs=1e-300)
        assert abs(got - 0.5 * math.erfc(-x / math.sqrt(2))) < 2e-15


def test_t_quantile(spark):
    # Published 0.975 quantiles.
    known = {1: 12.7062047362, 2: 4.3026527297, 5: 2.5705818356, 10: 2.2281388520, 30: 2.0422724563, 200: 1.9718962236}
    got = values(spark, list(known), lambda c: student.t_quantile(c, 0.975), "int")
    assert values(spark, [3_000_000_000], lambda c: student.t_quantile(c, 0.975), "long") == pytest.approx([1.959963985])
    assert got == pytest.approx(list(known.values()), abs=1e-9)
    (at_200, at_201), below = values(spark, [200, 201], lambda c: student.t_quantile(c, 0.975), "int"), [0, None]
    assert 0 < at_200 - at_201 < 1e-4
    assert values(spark, below, lambda c: student.t_quantile(c, 0.975), "int") == [None, None]


def test_bf_text(spark):
    cases = {0.5: "0.5", 1.0: "1", 1.234: "1.23", 1.001: "1", 12.6: "13", 999.4: "999", 1000.0: "1.0e+03", 12345.0: "1.2e+04", 0.001: "0"}
    assert values(spark, list(cases), text.bf_text) == list(cases.values())


def test_number_text(spark):
    assert values(spark, [0.5, 1.0, -0.001, 10.0, -1.25, None], text.number_text) == ["0.5", "1", "0", "10", "-1.25", None]


def test_small_texts(spark):
    assert values(spark, ["0.5", "-0.5", "0", "10.05"], text.drop_leading_zero, "string") == [".5", "-.5", "0", "1.05"]
    assert values(spark, ["a", None], lambda c: text.paste(c, F.lit("b"), sep="_"), "string") == ["a_b", "NA_b"]
    assert values(spark, ["cue", "x"], lambda c: text.recode(c, {"cue": "Att. cue"}), "string") == ["Att. cue", None]
    assert values(spark, ["low"], text.title, "string") == ["Low"]


def test_names(spark):
    row = spark.createDataFrame([("exp2", "baserate", "full", "present", "low")], "experiment string, bias_source string, model_name string, bias_direction string, contrast_level string")
    assert row.select(text.fit_name(), text.stim_label(sep="/")).first()[:] == ("exp2_bas_full", "Present/Low contrast")


def test_round_even_and_links(spark):
    assert values(spark, [0.5, 1.5, 2.5], numeric.round_even) == [0.0, 2.0, 2.0]
    assert values(spark, [0.0, 800.0, -800.0], numeric.inv_logit) == [0.5, 1.0, 0.0]
    assert values(spark, [0.0, 6.0], numeric.pseudo_log) == pytest.approx([0.0, math.asinh(3)])
    got = values(spark, [1.5], lambda c: numeric.normal_lpdf(c, F.lit(1.0), F.lit(2.0)))
    assert got[0] == pytest.approx(math.log(NormalDist(1, 2).pdf(1.5)))


def test_random_numbers(spark):
    rows = spark.range(20000).withColumn("h", numeric.key_number(F.col("id") % 7, seed=4, stream="s"))
    rows = numeric.with_numbers(rows, **{f"n{k}": ("h", "id", k) for k in range(3)})
    parts = rows.select(*[numeric.uniform(f"n{k}").alias(f"u{k}") for k in range(3)], numeric.normal("n1", "n2").alias("z"))
    s = parts.agg(*[F.avg(c).alias(c) for c in parts.columns], F.corr("u0", "u1").alias("r"), F.var_samp("z").alias("v")).first()
    assert all(abs(s[f"u{k}"] - 0.5) < 0.01 for k in range(3))
    assert abs(s["z"]) < 0.03 and abs(s["v"] - 1) < 0.05 and abs(s["r"]) < 0.03
    again = rows.repartition(7).agg(F.sum(numeric.uniform("n0"))).first()[0]
    assert again == pytest.approx(rows.agg(F.sum(numeric.uniform("n0"))).first()[0])
