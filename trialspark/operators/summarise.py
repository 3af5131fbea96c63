"""Per-cell and per-condition summaries. All are hash aggregates with map-side combination unless noted."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.student import t_quantile
from ..functions.text import paste, recode
from ..schema import CELL, DESIGN, PAIR, SOURCE_LABELS
from .exclude import participant_counts
from .frame import by_task, is_present, parse_abs
from .joins import null_safe_join
from .ranking import exact_median


def proportion_present(trials: DataFrame, keys=CELL) -> DataFrame:
    answers = by_task(trials, "detection")
    return answers.groupBy(*keys).agg(F.avg(is_present("answer")).alias("proportion_present"))


def reproductions(trials: DataFrame, value="value") -> DataFrame:
    """Reproduction trials with the answer as a magnitude."""
    return by_task(trials, "reproduction").withColumn(value, parse_abs("answer"))


def mean_reproduction(trials: DataFrame, keys=CELL) -> DataFrame:
    return reproductions(trials).groupBy(*keys).agg(F.avg("value").alias("reproduction"))


def proportion_zero(trials: DataFrame, keys=CELL, mode="share") -> DataFrame:
    """`share`: how often the answer is 0. `ceiling`: one minus the mean of rounded-up answers, equal while answers ≤ 1."""
    if mode not in ("share", "ceiling"):
        raise ValueError(f"unknown mode {mode!r}")
    share = F.avg((F.col("value") == 0).cast("int")) if mode == "share" else 1 - F.avg(F.ceil("value"))
    return reproductions(trials).groupBy(*keys).agg(share.cast("double").alias("prop_zero"))


def mean_nonzero(trials: DataFrame, keys=CELL) -> DataFrame:
    """Mean of the non-zero answers; a cell without any is kept with NULL."""
    return reproductions(trials).groupBy(*keys).agg(F.avg(F.when(F.col("value") != 0, F.col("value"))).alias("value"))


def median_nonzero(trials: DataFrame, keys=CELL) -> DataFrame:
    """Exact median of the non-zero answers; cells without any are absent."""
    return exact_median(reproductions(trials).where(F.col("value") != 0), keys, "value", "value")


def empty_cells(trials: DataFrame) -> DataFrame:
    """Participants and levels with non-zero answers in only one of the two directions."""
    answered = reproductions(trials).where(F.col("value") != 0)
    per_direction = [F.count_if(F.col("bias_direction") == d).alias(f"n_{d}") for d in ("control", "present")]
    return answered.groupBy(*PAIR).agg(*per_direction).where((F.col("n_control") == 0) | (F.col("n_present") == 0))


def incomplete_pairs(summary: DataFrame) -> DataFrame:
    """Participants and levels for which a per-direction summary has only one of the two rows."""
    present = F.count_if(F.col("bias_direction") == "present"), F.count_if(F.col("bias_direction") == "control")
    return summary.groupBy(*PAIR).agg(F.least(*present).alias("_n")).where(F.col("_n") == 0).drop("_n")


def empty_cell_counts(empty: DataFrame) -> DataFrame:
    return empty.groupBy("experiment", "bias_source", "contrast_level").agg(F.count(F.lit(1)).alias("n"))


def mean_se(df: DataFrame, keys, col) -> DataFrame:
    """Mean with one standard error on either side, NULLs left out."""
    return _interval(df, keys, col, F.lit(1.0))


def mean_ci(df: DataFrame, keys, col, level=0.95) -> DataFrame:
    """Mean with its t interval, NULLs left out."""
    return _interval(df, keys, col, t_quantile(F.col("n") - 1, 0.5 + level / 2))


def _interval(df, keys, col, multiple):
    stats = df.groupBy(*keys).agg(
        F.count(col).alias("n"), F.avg(col).alias("y"), F.stddev_samp(col).alias("_sd")
    )
    reach = multiple * F.col("_sd") / F.sqrt(F.nullif(F.col("n"), F.lit(0)))
    return stats.withColumns({"ymin": F.col("y") - reach, "ymax": F.col("y") + reach}).drop("_sd")


def histogram(df: DataFrame, facets, col="value", width=0.003, limits=None) -> DataFrame:
    """Counts in bins centred on multiples of `width`, right edge included; rows outside `limits` are dropped first."""
    rows = df.where(F.col(col).isNotNull())
    if limits is not None:
        rows = rows.where(F.col(col).between(*[float(x) for x in limits]))
    # An edge value may sit a rounding error above its edge; the tolerance keeps it in its bin.
    bin_number = F.ceil((F.col(col) - width / 2) / width - 1e-8).cast("long")
    counted = rows.groupBy(*facets, bin_number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("centre", F.col("bin") * F.lit(float(width)))


def axis_grid(df: DataFrame, keys, col, step) -> DataFrame:
    """Tick positions from the smallest value upward, up to the largest."""
    ends = df.groupBy(*keys).agg(F.min(col).alias("_min"), F.max(col).alias("_max")).where(F.col("_min").isNotNull())
    steps = F.floor((F.col("_max") - F.col("_min")) / step + 1e-10).cast("int")
    ticks = ends.select(*keys, "_min", F.explode(F.sequence(F.lit(0), steps)).alias("tick"))
    return ticks.select(*keys, "tick", (F.col("_min") + F.col("tick") * F.lit(float(step))).alias("position"))


def source_labels(trials: DataFrame, labels=None) -> DataFrame:
    """Display label with sample size for every source, also for one an experiment lacks (`N=NA`)."""
    labels = SOURCE_LABELS if labels is None else labels
    counts = participant_counts(trials)
    expected = counts.select("experiment").distinct().withColumn(
        "bias_source", F.explode(F.array(*[F.lit(s) for s in labels]))
    )
    return label_join(null_safe_join(counts, expected, ["experiment", "bias_source"], "full"), labels)


def label_join(counts: DataFrame, labels: dict) -> DataFrame:
    name = recode("bias_source", labels)
    return counts.withColumn("label", paste(name, F.lit(" (N="), "n", F.lit(")")))


def observed_cells(frame: DataFrame, keys=DESIGN) -> DataFrame:
    """Observed side of a predictive check in one aggregate: non-zero mean, zero share and overall mean."""
    response = F.col("response")
    return frame.groupBy(*keys).agg(
        F.avg(F.when(response != 0, response)).alias("response_non_zero"),
        F.avg((response == 0).cast("int")).alias("prop_zero"),
        F.avg(response).alias("response"),
    )
