"""Participant counts and the staged exclusion of participants."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DIRECTIONS, PARTICIPANT
from ..session import materialize
from .frame import parse_abs, stack
from .joins import exclude_keys, lookup_join
from .sdt import confusion_aggregates, with_sdt

STAGES = ["staircase", "low_dprime", "dprime", "reproduction"]
BOUNDS = ["mean", "upper_boundary", "lower_boundary"]


def participant_counts(trials: DataFrame) -> DataFrame:
    people = trials.select(*PARTICIPANT).distinct().where(F.col("participant").isNotNull())
    return people.groupBy("experiment", "bias_source").agg(F.count(F.lit(1)).alias("n"))


def trial_counts(trials: DataFrame) -> DataFrame:
    """The different trial numbers that occur in each design."""
    per_person = trials.groupBy(*PARTICIPANT).agg(F.count(F.lit(1)).alias("n_trials"))
    return per_person.select("experiment", "bias_source", "n_trials").distinct()


def first_row(df: DataFrame, keys, order, cols) -> DataFrame:
    """The listed columns of the first row of each key. An aggregate, so nothing is sorted and big keys combine early."""
    first = F.min_by(F.struct(*cols), F.col(order))
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, "_first.*")


def start_balance(trials: DataFrame) -> DataFrame:
    """How many participants began with each direction."""
    start = first_row(trials, PARTICIPANT, "trial_index", ["bias_direction"])
    return start.groupBy("experiment", "bias_source").agg(
        *[F.nullif(F.count_if(F.col("bias_direction") == d), F.lit(0)).alias(d) for d in DIRECTIONS]
    )


def zscore_bounds(df: DataFrame, keys, value="value", sd_threshold=4.0, na="skip") -> DataFrame:
    """Mean and mean ± `sd_threshold` standard deviations per key.

    With `na='propagate'` one missing value leaves its key without bounds, so none of its rows can be flagged.
    """
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("_sd"),
        F.count(value).alias("_known"),
        F.count(F.lit(1)).alias("_rows"),
    )
    if na == "propagate":
        stats = stats.where(F.col("_known") == F.col("_rows"))
    reach = F.col("_sd") * F.lit(float(sd_threshold))
    return stats.select(
        *keys,
        "mean",
        (F.col("mean") + reach).alias("upper_boundary"),
        (F.col("mean") - reach).alias("lower_boundary"),
        (F.col("_sd") == 0).alias("_constant"),
    )


def outside(value="value"):
    """On or beyond a bound. All rows of a constant key are; a single row (no standard deviation) is not."""
    beyond = (F.col(value) >= F.col("upper_boundary")) | (F.col(value) <= F.col("lower_boundary"))
    return F.coalesce(beyond | (F.col("_constant") & F.col(value).isNotNull()), F.lit(False))


def zscore_outliers(df: DataFrame, keys, value="value", sd_threshold=4.0, na="skip") -> DataFrame:
    """Flagged rows with their thresholds. Two aggregates and a lookup: a window per key would be one task per key."""
    bounds = zscore_bounds(df, keys, value, sd_threshold, na)
    return lookup_join(df, bounds, keys, "inner").where(outside(value)).drop("_constant")


def reproduction_error(trials: DataFrame, keys=(*PARTICIPANT, "bias_direction"), na="skip") -> DataFrame:
    """Mean signed error (shown minus reproduced magnitude) per participant and direction."""
    error = F.abs("target_contrast") - parse_abs("answer")
    mean = F.avg(error)
    if na == "propagate":
        mean = F.when(F.count(error) == F.count(F.lit(1)), mean)
    return trials.where(F.col("trial_type") == "reproduction").groupBy(*keys).agg(mean.alias("value"))


def trial_statistics(trials: DataFrame) -> DataFrame:
    """All that the exclusion stages need from the trials, in one pass: sums per participant, direction and target.

    A stage removes whole participants, so the later stages can work on these sums instead of filtered trials.
    """
    detection, reproduction = (F.coalesce(F.col("trial_type") == t, F.lit(False)) for t in ("detection", "reproduction"))
    error = F.when(reproduction, F.abs("target_contrast") - parse_abs("answer"))
    return trials.groupBy(*PARTICIPANT, "bias_direction", "target_contrast").agg(
        *confusion_aggregates(detection),
        F.count_if(detection).alias("n_detection"),
        F.count_if(reproduction).alias("n_reproduction"),
        F.sum(error).alias("error_sum"),
        F.count(error).alias("error_n"),
    )


def staircase_values(statistics: DataFrame) -> DataFrame:
    """The distinct non-zero targets of each participant."""
    shown = statistics.where(F.col("target_contrast") != 0)
    return shown.select(*PARTICIPANT, F.col("target_contrast").alias("value")).distinct()


def exclusion_log(trials: DataFrame, sd_threshold=4.0, na="skip") -> DataFrame:
    """Why each participant is excluded: one row per offending value, with its stage and thresholds.

    Stages in order, each on what the former left: extreme staircase targets; d' of 0 or less; extreme d'; extreme mean
    reproduction error. One bad value removes the participant. The trials are read once.
    """
    statistics = materialize(trial_statistics(trials))
    by_person = Window.partitionBy(*PARTICIPANT)  # a row per direction, never the trials

    def survivors(df, flag):
        return df.withColumn("_out", F.max(flag).over(by_person)).where(~F.col("_out")).drop("_out")

    def judged(df, value, rows):
        bounds = zscore_bounds(df.where(rows), ["experiment"], value, sd_threshold, na)
        joined = lookup_join(df.drop(*BOUNDS, "_constant"), bounds, ["experiment"], "left")
        return joined.withColumn("_flag", rows & outside(value))

    bounds = zscore_bounds(staircase_values(statistics), ["experiment"], "value", sd_threshold, na)
    targets = lookup_join(statistics.withColumn("value", F.col("target_contrast")), bounds, ["experiment"], "left")
    targets = targets.withColumn("_flag", F.coalesce(F.col("value") != 0, F.lit(False)) & outside())
    staircase = targets.where("_flag").select(*PARTICIPANT, "value", *BOUNDS).distinct()

    sums = [*("hits", "misses", "correct_rejections", "false_alarms"), "n_detection", "n_reproduction", "error_sum", "error_n"]
    cells = targets.groupBy(*PARTICIPANT, "bias_direction").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("_flag").alias("_flag")
    )
    mean_error = F.try_divide(F.col("error_sum"), F.col("error_n"))
    if na == "propagate":
        mean_error = F.when(F.col("error_n") == F.col("n_reproduction"), mean_error)
    # Stored: four uses follow, all on one row per participant and direction.
    cells = materialize(with_sdt(survivors(cells, F.col("_flag"))).withColumn("error", mean_error))

    tested = F.col("n_detection") > 0
    too_low = tested & (F.col("d") <= 0)
    low = cells.where(too_low).withColumn("value", F.col("d"))

    sensitive = judged(survivors(cells, too_low), "d", tested)
    extreme_d = sensitive.where("_flag").withColumn("value", F.col("d"))

    reproduced = judged(survivors(sensitive, F.col("_flag")), "error", F.col("n_reproduction") > 0)
    extreme_error = reproduced.where("_flag").withColumn("value", F.col("error"))

    parts = []
    for stage, rows in zip(STAGES, (staircase, low, extreme_d, extreme_error)):
        wanted = [c for c in (*PARTICIPANT, "bias_direction", "value", *BOUNDS) if c in rows.columns]
        parts.append(rows.select(F.lit(stage).alias("stage"), *wanted))
    return stack(*parts).select("stage", *PARTICIPANT, "bias_direction", "value", *BOUNDS)


def exclude(trials: DataFrame, sd_threshold=4.0, na="skip") -> tuple[DataFrame, DataFrame]:
    """Trials of the participants that pass all stages, and the exclusion log."""
    log = materialize(exclusion_log(trials, sd_threshold, na))
    return exclude_keys(trials, log, PARTICIPANT), log


def exclusion_summary(*logs: DataFrame) -> DataFrame:
    """Excluded participants per experiment and source; a participant listed twice counts once."""
    people = stack(*logs).select(*PARTICIPANT).distinct()
    return people.groupBy("experiment", "bias_source").agg(F.count(F.lit(1)).alias("n"))


