"""Predictive checks joined with data, and tables of condition effects."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CONDITION, DESIGN, MODELS, PARTICIPANT
from .frame import by_task, is_present
from .joins import key_grid, merge_cells
from .reshape import pair_diff
from .summarise import mean_ci, mean_se, observed_cells

MEAN_CELL = [*PARTICIPANT, "cond", "contrast_level"]
CONDITION_CELL = ["experiment", "bias_source", "cond", "contrast_level"]


def predictive_check(frame: DataFrame, predicted: DataFrame, models=MODELS) -> DataFrame:
    """Observed and predicted cells side by side: a row for every observed cell under every model, predicted or not."""
    return merge_cells(predicted, key_grid(observed_cells(frame), model_name=models), [*DESIGN, "model_name"])


def sampled_means(sums: DataFrame) -> DataFrame:
    """Mean sampled response per participant, condition, level and model, from the sums of `draws.conditional_sums`."""
    return sums.groupBy(*MEAN_CELL, "model_name").agg(F.try_divide(F.sum("pred_sum"), F.sum("n_pred")).alias("value"))


def predicted_means(sums: DataFrame) -> DataFrame:
    """Mean over participants of the mean sampled response, with one standard error."""
    return mean_se(sampled_means(sums), [*CONDITION_CELL, "model_name"], "value")


def nonzero_effect(frame: DataFrame) -> DataFrame:
    """Observed condition effect on the mean non-zero response, tagged `empirical`."""
    means = frame.where(F.col("response") != 0).groupBy(*MEAN_CELL).agg(F.avg("response").alias("value"))
    return effect_table(means, "value", [*PARTICIPANT, "contrast_level"], CONDITION).withColumn("data_type", F.lit("empirical"))


def perceived_vs_observed(frame: DataFrame, sums: DataFrame, model="full") -> DataFrame:
    """Effects on sampled non-zero predictions of one model (`predicted`) stacked with the observed ones (`empirical`)."""
    means = sampled_means(sums.where(F.col("model_name") == model)).drop("model_name")
    predicted = effect_table(means, "value", [*PARTICIPANT, "contrast_level"], CONDITION).withColumn("data_type", F.lit("predicted"))
    return predicted.unionByName(nonzero_effect(frame))


def effect_table(cells: DataFrame, value: str, unit, keys, level=0.95) -> DataFrame:
    """Mean condition effect (present minus control) with its t interval; `unit` pairs the two conditions."""
    effects = pair_diff(cells, unit, "control", "present", value, by="cond")
    return mean_ci(effects, keys, "diff", level)


def absent_share(trials: DataFrame) -> DataFrame:
    """Share of detection answers other than `present`, per participant, condition and level."""
    detection = by_task(trials, "detection").withColumnRenamed("bias_direction", "cond")
    return detection.groupBy(*MEAN_CELL).agg(F.avg(1 - is_present("answer", strict=False)).alias("answer"))


def hurdle_and_detection(predicted: DataFrame, trials: DataFrame) -> DataFrame:
    """Mean hurdle probability over stimuli joined with the share of absent answers."""
    hurdle = predicted.groupBy(*MEAN_CELL).agg(F.avg("hurdle_prob").alias("hurdle_prob"))
    return merge_cells(hurdle, absent_share(trials), MEAN_CELL)


def hurdle_vs_detection(both: DataFrame) -> DataFrame:
    """Means over participants per condition: a mean of participant means, not a pooled one."""
    return both.groupBy(*CONDITION_CELL).agg(F.avg("hurdle_prob").alias("hurdle_prob"), F.avg("answer").alias("answer"))
