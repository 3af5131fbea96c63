"""Effect regressions: one task's condition effect against the other's."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import normal_cdf, round_even
from ..functions.student import t_quantile
from ..schema import PARTICIPANT
from ..session import materialize
from .joins import lookup_join
from .reshape import diff_by_measure

MEASURES = ["hurdle_prob", "answer"]


def logit_adjusted(df: DataFrame, cols, keys=("experiment",), adjust=0.025) -> DataFrame:
    """Logit of the listed columns taken together per key.

    If any value is 0 or 1, all values of the key move towards one half first; above 1 they are read as percentages.
    The range must be known before any value can be moved, so the input is stored and read twice.
    """
    df = materialize(df)
    scope = df.groupBy(*keys).agg(
        *[f(c).alias(f"_{name}_{c}") for c in cols for name, f in (("low", F.min), ("high", F.max))]
    )

    def extreme(name, pick):
        return reduce(pick, [F.col(f"_{name}_{c}") for c in cols]) if len(cols) == 1 else pick(
            *[F.col(f"_{name}_{c}") for c in cols]
        )

    scope = scope.select(*keys, extreme("low", F.least).alias("_low"), extreme("high", F.greatest).alias("_high"))
    unit = F.when(F.col("_high") > 1, 100.0).otherwise(1.0)
    touches = (F.col("_low") == 0) | (F.col("_high") == unit)
    scope = scope.select(*keys, unit.alias("_unit"), F.when(touches, 1 - 2 * adjust).otherwise(1.0).alias("_shrink"))
    joined = lookup_join(df, scope, list(keys))
    moved = {c: 0.5 + F.col("_shrink") * (F.col(c) / F.col("_unit") - 0.5) for c in cols}
    return joined.withColumns(moved).withColumns({c: F.ln(F.col(c) / (1 - F.col(c))) for c in cols}).drop("_unit", "_shrink")


def effect_logit(both: DataFrame, measures=MEASURES) -> DataFrame:
    """Condition effects (present minus control) of the inverted measures on the logit scale, one column per measure."""
    inverted = both.withColumns({m: 1 - F.col(m) for m in measures})
    logits = logit_adjusted(inverted, measures)
    return diff_by_measure(logits, [*PARTICIPANT, "contrast_level"], measures)


def effect_regression(df: DataFrame, keys=("experiment", "bias_source"), y="hurdle_prob", x="answer", within=False) -> DataFrame:
    """Least-squares line of `y` on `x` per key: n, slope, intercept, r2, standard error and the sums behind the band.

    `within` gives every participant an own intercept (sums are centred per participant before they are added up).
    """
    complete = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = [
        F.regr_count(F.col(y), F.col(x)).alias("n"),
        F.regr_sxx(F.col(y), F.col(x)).alias("sxx"),
        F.regr_syy(F.col(y), F.col(x)).alias("syy"),
        F.regr_sxy(F.col(y), F.col(x)).alias("sxy"),
        F.avg(x).alias("x_mean"),
        F.avg(y).alias("y_mean"),
    ]
    if within:
        people = complete.groupBy(*dict.fromkeys([*keys, *PARTICIPANT])).agg(*sums)
        n = F.col("n").cast("double")
        fit = people.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in ("sxx", "syy", "sxy")],
            (F.sum(n * F.col("x_mean")) / F.sum(n)).alias("x_mean"),
            (F.sum(n * F.col("y_mean")) / F.sum(n)).alias("y_mean"),
            F.sum("n").alias("n"),
            (F.sum("n") - F.count(F.lit(1)) - 1).alias("df"),
        )
    else:
        fit = complete.groupBy(*keys).agg(*sums).withColumn("df", F.col("n") - 2)
    fit = fit.withColumn("slope", F.try_divide("sxy", "sxx"))
    fit = fit.withColumns(
        {
            "intercept": F.col("y_mean") - F.col("slope") * F.col("x_mean"),
            "r2": F.try_divide(F.col("sxy") * F.col("sxy"), F.col("sxx") * F.col("syy")),
            "sigma": F.sqrt(
                F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
                / F.when(F.col("df") > 0, F.col("df").cast("double"))
            ),
        }
    )
    fit = fit.withColumns({"se": F.try_divide(F.col("sigma"), F.sqrt("sxx")), "r2_rounded": round_even("r2", 2)})
    return fit.select(*keys, "n", "df", "slope", "intercept", "r2", "r2_rounded", "se", "sigma", "sxx", "x_mean")


def slope_evidence(fit: DataFrame) -> DataFrame:
    """Odds of a positive against a negative slope under the normal approximation of its estimate."""
    z = F.try_divide("slope", "se")
    return fit.withColumn("evidence_ratio", F.try_divide(normal_cdf(z), normal_cdf(-z)))


def regression_line(df: DataFrame, fit: DataFrame, keys=("experiment", "bias_source"), x="answer", level=0.95) -> DataFrame:
    """The fitted line with its confidence band at the observed x values."""
    points = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("x")).distinct()
    joined = lookup_join(points, fit, list(keys), "inner")
    apart = F.col("x") - F.col("x_mean")
    se = F.col("sigma") * F.sqrt(1.0 / F.col("n") + F.try_divide(apart * apart, F.col("sxx")))
    reach = t_quantile("df", 0.5 + level / 2) * se
    line = F.col("intercept") + F.col("slope") * F.col("x")
    return joined.select(*keys, "x", line.alias("y"), (line - reach).alias("ymin"), (line + reach).alias("ymax"))
