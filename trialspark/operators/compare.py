"""Paired comparisons of two bias directions, from sufficient statistics."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import normal_cdf
from ..functions.text import bf_plot_labels
from ..schema import CONDITION, PAIR
from .joins import null_safe_join
from .ranking import avg_rank, ordered_counts
from .reshape import pair_diff

DIRECTIONS = ("control", "present")


def pairs(df: DataFrame, value="value", conditions=DIRECTIONS, unit=PAIR, by="bias_direction") -> DataFrame:
    """One row per unit with the difference first minus second condition; NULL where a side is missing."""
    first, second = conditions
    return pair_diff(df, unit, second, first, value, by)


def paired_effects(df: DataFrame, keys=CONDITION, value="value", conditions=DIRECTIONS, unit=PAIR) -> DataFrame:
    """Per key: complete and dropped pairs, mean and standard deviation of the difference, t and Cohen's d.

    t follows the difference first minus second condition, d the opposite one.
    """
    stats = pairs(df, value, conditions, unit).groupBy(*keys).agg(
        F.count("diff").alias("n_pairs"),
        F.count_if(F.col("diff").isNull()).alias("n_dropped"),
        F.avg("diff").alias("mean_diff"),
        F.stddev_samp("diff").alias("sd_diff"),
    )
    spread = F.nullif(F.col("sd_diff"), F.lit(0.0))
    return stats.withColumns(
        {"t": F.col("mean_diff") / spread * F.sqrt("n_pairs"), "d": -F.col("mean_diff") / spread}
    )


def log_bf_negative(rscale: float):
    """Column function of (t, n): log Bayes factor of a negative against a zero effect, Cauchy prior of width `rscale`.

    One integral per row, and the rows are conditions, not trials. With y the chi-distributed scale and
    mu = sqrt(n) * effect, the likelihood is a unit normal in mu around a = t * y / sqrt(nu). Both integrals are centred
    on their mass, so large samples need no finer grid. All is local to this function, so it ships to workers by value.
    """
    nodes, weights = np.polynomial.legendre.leggauss(256)

    def chi(nu, scale):
        low, high = max(np.sqrt(nu) - 10.0, 0.0) * scale, (np.sqrt(nu) + 10.0) * scale
        y = low + (high - low) * (nodes + 1) / 2
        shift = y - np.sqrt(nu)
        log_weight = nu * np.log1p(shift / np.sqrt(nu)) - shift * np.sqrt(nu) - shift**2 / 2
        return y, log_weight + np.log(weights * (high - low) / 2)

    def log_bf(t, n):
        nu = n - 1.0
        y, outer = chi(nu, 1.0 if t <= 0 else 1.0 / np.sqrt(1.0 + t * t / nu))
        a = (t / np.sqrt(nu)) * y
        edge = -a  # mu < 0 means u < -a
        low = np.where(edge <= 0, -np.sqrt(edge**2 + 76.0), -np.sqrt(76.0))
        high = np.minimum(edge, np.sqrt(76.0))
        half = (high - low)[:, None] / 2
        u = low[:, None] + half * (nodes + 1)[None, :]
        width = rscale * np.sqrt(n)
        prior = np.log(2 / (np.pi * width)) - np.log1p(((a[:, None] + u) / width) ** 2)
        inner = np.logaddexp.reduce(prior - u**2 / 2 + np.log(weights)[None, :] + np.log(half), axis=1)
        _, plain = chi(nu, 1.0)
        top, bottom = np.logaddexp.reduce(outer + inner), np.logaddexp.reduce(plain)
        return float((nu + 1) / 2 * np.log1p(t * t / nu) + top - bottom)

    @F.pandas_udf(T.DoubleType())
    def column(t: pd.Series, n: pd.Series) -> pd.Series:
        known = (t.notna() & (n > 1)).to_numpy()
        return pd.Series([log_bf(a, b) if k else None for a, b, k in zip(t, n, known)], dtype="float64")

    return column


def paired_bf(df: DataFrame, keys=CONDITION, value="value", conditions=DIRECTIONS, rscale=0.707, unit=PAIR) -> DataFrame:
    """Paired effects with the one-sided Bayes factor for first below second condition; NULL without spread."""
    effects = paired_effects(df, keys, value, conditions, unit)
    scored = effects.withColumn("log_bf", log_bf_negative(float(rscale))("t", "n_pairs"))
    scored = scored.withColumn("log_bf", F.when(~F.isnan("log_bf"), F.col("log_bf")))
    return scored.withColumn("bf", F.exp("log_bf"))


def bf_labels(scored: DataFrame) -> DataFrame:
    return scored.select("*", *bf_plot_labels("bf", "d"))


def signed_rank_tails(ranks, twice_plus):
    """(p_less, p_greater): exact chances that the positive ranks add up to at most, and at least, half of `twice_plus`.

    `ranks`: SQL of an array of doubled ranks, whole numbers, so that ties count as they are. The signs are fair coins:
    the distribution of the sum is that of one rank more after each, in an array with a place per possible sum.
    """
    start = f"transform(sequence(0, aggregate({ranks}, 0, (a, r) -> a + r)), i -> IF(i = 0, 1D, 0D))"
    added = "transform(dist, (x, i) -> (x + IF(i >= r, dist[IF(i >= r, i - r, 0)], 0D)) / 2)"
    dist = f"aggregate({ranks}, {start}, (dist, r) -> {added})"
    tails = [f"aggregate(filter({dist}, (x, i) -> i {side} {twice_plus}), 0D, (a, x) -> a + x)" for side in ("<=", ">=")]
    return tuple(F.expr(x) for x in tails)


def signed_rank(df: DataFrame, keys=CONDITION, value="value", conditions=DIRECTIONS, unit=PAIR, exact_pairs=50) -> DataFrame:
    """Signed-rank sums of the paired differences with tie-corrected normal z; zero differences are left out.

    Every group has a row: `n_zero` differences were zero, `n_dropped` pairs incomplete. Without a pair left the sums are 0
    and z is NULL. `p_less` and `p_greater` are the one-sided p values, the chances of positive ranks that add up to at most
    or at least what they do. Up to `exact_pairs` pairs they come from the exact distribution given the ties (`exact`), so
    without a pair they are 1; beyond they are those of z.
    """
    differences = pairs(df, value, conditions, unit)
    groups = differences.groupBy(*keys).agg(
        F.count_if(F.col("diff") == 0).alias("n_zero"), F.count_if(F.col("diff").isNull()).alias("n_dropped")
    )
    sized = differences.where(F.col("diff") != 0).withColumn("size", F.abs("diff"))
    ranked = ordered_counts(sized, keys, "size", positive=F.count_if(F.col("diff") > 0)).withColumn("rank", avg_rank())
    # The doubled ranks with their numbers, for small groups alone: `total` is the size of the group.
    tied = F.when(F.col("total") <= exact_pairs, F.struct((2 * F.col("rank")).cast("int").alias("rank"), F.col("n").cast("int").alias("n")))
    sums = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n_pairs"),
        F.sum(F.col("rank") * F.col("positive")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("n") - F.col("positive"))).alias("w_minus"),
        F.sum(F.pow(F.col("n").cast("double"), 3.0) - F.col("n")).alias("_ties"),
        F.collect_list(tied).alias("_tied"),
    )
    found = null_safe_join(groups, sums, keys, "left")
    found = found.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_pairs", "w_plus", "w_minus", "_ties")})
    n = F.col("n_pairs").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(F.nullif(variance, F.lit(0.0)))
    found = found.withColumns({"z": z, "exact": F.col("n_pairs") <= exact_pairs})
    found = found.withColumn("_ranks", F.expr("flatten(transform(coalesce(_tied, array()), t -> array_repeat(t.rank, t.n)))"))
    less, greater = signed_rank_tails("_ranks", "2 * w_plus")
    found = found.withColumns(
        {"p_less": F.when(F.col("exact"), less).otherwise(normal_cdf(F.col("z"))), "p_greater": F.when(F.col("exact"), greater).otherwise(normal_cdf(-F.col("z")))}
    )
    return found.drop("_ties", "_tied", "_ranks")
