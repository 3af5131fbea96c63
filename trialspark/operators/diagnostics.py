"""Convergence diagnostics and evidence from long draws tables (keys, parameter, chain, iteration, value)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import qnorm
from ..session import materialize
from .joins import lookup_join, null_safe_join
from .ranking import avg_rank, median_of_placed, ordered_counts, place_values, rank_placed

FIT_KEYS = ["experiment", "condition", "model_name"]


def chain_lengths(draws: DataFrame, keys=FIT_KEYS) -> DataFrame:
    """One row per chain: its first iteration, the step between iterations, its length `n` and whether a value is missing.

    A regular chain is numbered first, first + step, ..; it may start late and be thinned. `regular` is checked through
    the count, the range and the sums of the positions and of their squares.
    """
    at = F.col("iteration").cast("decimal(38,0)")
    missing = F.col("value").isNull() | F.isnan("value")
    sums = draws.groupBy(*keys, "parameter", "chain").agg(
        F.count("iteration").alias("n"), F.count(F.lit(1)).alias("_rows"), F.min("iteration").alias("first"), F.max("iteration").alias("_last"),
        F.sum(at).alias("_sum"), F.sum(at * at).alias("_squares"), F.bool_or(missing).alias("missing"),
    )
    n, first = F.col("n"), F.col("first")
    step = F.greatest(F.floor((F.col("_last") - first) / F.greatest(n - 1, F.lit(1))), F.lit(1))
    offset, squares = F.col("_sum") - n * first, F.col("_squares") - 2 * first * F.col("_sum") + n * first * first
    regular = (
        (n == F.col("_rows"))
        & (first + F.col("step") * (n - 1) == F.col("_last"))
        & (2 * offset == F.col("step") * n * (n - 1))
        & (6 * squares == F.col("step") * F.col("step") * n * (n - 1) * (2 * n - 1))
    )
    return sums.withColumn("step", step).withColumn("regular", regular).select(*keys, "parameter", "chain", "first", "step", "n", "missing", "regular")


def _checked(lengths, unit):
    """Chains with the length of their halves; an error names a parameter whose chains are irregular or unequal."""
    per = lengths.groupBy(*unit).agg(F.min("n").alias("_least"), F.max("n").alias("_most"), F.bool_and("regular").alias("_regular"))
    wrong = ~F.col("_regular") | (F.col("_least") != F.col("_most"))
    message = F.concat(F.lit("chains of unequal length or irregular numbering: "), F.concat_ws(", ", *unit))
    half = F.when(wrong, F.raise_error(message).cast("long")).otherwise(F.floor(F.col("_least") / 2))
    return null_safe_join(lengths, per.select(*unit, half.alias("_half")), unit)


def split_chains(draws: DataFrame, keys=FIT_KEYS, lengths: DataFrame = None) -> DataFrame:
    """Draws with the half-chain they belong to: the first and last floor(n / 2) of each chain, by position.

    Of an odd length the middle draw is left out. Chains of one parameter must have one length and a regular numbering;
    otherwise this raises an error. No draw is cut for the sake of another chain.
    """
    unit = [*keys, "parameter"]
    lengths = _checked(chain_lengths(draws, keys), unit) if lengths is None else lengths
    known = lookup_join(draws, lengths.select(*unit, "chain", "first", "step", "n", "_half"), [*unit, "chain"], "inner")
    place = (F.col("iteration") - F.col("first")) / F.col("step")
    late = place >= F.col("n") - F.col("_half")
    kept = known.withColumn("_late", late).where((place < F.col("_half")) | F.col("_late"))
    return kept.select(*unit, "value", (F.col("chain") * 2 + F.col("_late").cast("int")).alias("half"))


def _potential_scale(chains: DataFrame, unit) -> DataFrame:
    """From (mean, variance, n) per half-chain; NULL for a constant parameter."""
    parts = chains.groupBy(*unit).agg(
        F.avg("_var").alias("_within"), F.var_samp("_mean").alias("_between"), F.max("_n").cast("double").alias("_n")
    )
    within = F.nullif(F.col("_within"), F.lit(0.0))
    n = F.col("_n")
    return parts.select(*unit, F.sqrt(((n - 1) / n * within + F.col("_between")) / within).alias("rhat"))


def _split_rhat(split: DataFrame, unit) -> DataFrame:
    chains = split.groupBy(*unit, "half").agg(
        F.avg("value").alias("_mean"), F.var_samp("value").alias("_var"), F.count("value").alias("_n")
    )
    return _potential_scale(chains, unit)


def _normalised_rhat(ranked: DataFrame, unit) -> DataFrame:
    """From ranked values per half-chain: the statistic of their normal scores. Ties are one row per half-chain."""
    z = qnorm((avg_rank() - 0.375) / (F.col("total") + 0.25))
    n = F.col("count").cast("double")
    chains = ranked.withColumn("_z", z).groupBy(*unit, "half").agg(
        F.sum(n).alias("_n"), F.sum(n * F.col("_z")).alias("_sum"), F.sum(n * F.col("_z") * F.col("_z")).alias("_squares")
    )
    mean = F.col("_sum") / F.col("_n")
    # Scores of one constant value differ by rounding only; anything real is far above this.
    spread = (F.col("_squares") - F.col("_sum") * mean) / F.nullif(F.col("_n") - 1, F.lit(0.0))
    return _potential_scale(chains.withColumns({"_mean": mean, "_var": F.when(spread > 1e-12, spread).otherwise(0.0)}), unit)


def rhat(draws: DataFrame, keys=FIT_KEYS, rank=True) -> DataFrame:
    """Split r-hat per parameter; with `rank`, the larger of the rank-normalised and the folded one.

    NULL for a parameter with a missing value, a constant one and one with fewer than four draws a chain.
    """
    unit = [*keys, "parameter"]
    lengths = materialize(_checked(chain_lengths(draws, keys), unit))
    split = split_chains(draws, keys, lengths)
    units = lengths.groupBy(*unit).agg(F.bool_or("missing").alias("_missing"), F.sum("n").alias("_draws"))
    if rank:
        largest = units.agg(F.max("_draws")).first()[0] or 0
        placed = place_values(split, unit, "value", by=["half"], largest=largest)
        centre = median_of_placed(placed, "value", "_median")
        tallies = placed.select("_group.*", "half", "value", F.col("count").alias("held"))
        distance = lookup_join(tallies, centre, unit, "inner").withColumn("value", F.abs(F.col("value") - F.col("_median")))
        folded = ordered_counts(distance, unit, "value", by=["half"], weight="held", largest=largest)
        both = _normalised_rhat(rank_placed(placed, "value"), unit).unionByName(_normalised_rhat(folded, unit))
        found = both.groupBy(*unit).agg(F.max("rhat").alias("rhat"))
    else:
        found = _split_rhat(split, unit)
    known = null_safe_join(units, found, unit, "left")
    return known.select(*unit, F.when(~F.col("_missing"), F.col("rhat")).alias("rhat"))


def high_rhat(values: DataFrame, threshold=1.02) -> DataFrame:
    return values.where(F.col("rhat") > threshold)


def rhat_gate(values: DataFrame, threshold=1.02, keys=FIT_KEYS) -> DataFrame:
    """Per fit: parameters, how many exceed the threshold, the largest value and whether all known ones are below it."""
    return values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_parameters"),
        F.count_if(F.col("rhat") > threshold).alias("n_high"),
        F.max("rhat").alias("max_rhat"),
        F.bool_and(F.col("rhat") < threshold).alias("passed"),
    )


def trace(draws: DataFrame, parameters=None, every=1) -> DataFrame:
    """Thinned draws of the chosen parameters by chain and iteration."""
    chosen = draws if parameters is None else draws.where(F.col("parameter").isin(list(parameters)))
    return chosen.where(F.col("iteration") % every == 0)


def evidence_ratio(draws: DataFrame, keys, value="value") -> DataFrame:
    """Posterior odds of a positive against a negative effect; NULL when no draw is negative."""
    up, down = F.count_if(F.col(value) > 0), F.count_if(F.col(value) < 0)
    return draws.groupBy(*keys).agg(
        up.alias("n_positive"), down.alias("n_negative"), F.try_divide(up, down).alias("evidence_ratio")
    )


def bayes_r2(draws: DataFrame, keys) -> DataFrame:
    """Explained variance from predictions `mu` and `sigma` per draw, averaged over draws."""
    per_draw = draws.groupBy(*keys, "draw_id").agg(F.var_samp("mu").alias("_mu"), F.max("sigma").alias("_sigma"))
    share = F.col("_mu") / (F.col("_mu") + F.col("_sigma") * F.col("_sigma"))
    return per_draw.groupBy(*keys).agg(F.avg(share).alias("r2"))
