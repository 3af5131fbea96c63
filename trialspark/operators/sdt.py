"""Signal-detection counts and measures."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import qnorm
from ..schema import PARTICIPANT
from .frame import accuracy, by_task

COUNTS = ["hits", "misses", "correct_rejections", "false_alarms"]


def confusion_aggregates(condition=None) -> list:
    """The four confusion counts as aggregates; low and high contrast are pooled as signal."""
    right = accuracy("contrast_level", "answer")
    answer = F.col("answer")
    rows = F.lit(True) if condition is None else condition
    classes = {
        "hits": right & (answer == "present"),
        "misses": ~right & (answer == "absent"),
        "correct_rejections": right & (answer == "absent"),
        "false_alarms": ~right & (answer == "present"),
    }
    return [F.count_if(rows & hit).alias(name) for name, hit in classes.items()]


def confusion_counts(trials: DataFrame, keys=(*PARTICIPANT, "bias_direction")) -> DataFrame:
    return by_task(trials, "detection").groupBy(*keys).agg(*confusion_aggregates())


def with_sdt(df: DataFrame) -> DataFrame:
    """Hit rate, false-alarm rate and the measures built on them.

    One empty class shifts all four counts by a half. `ccrit` keeps the plus sign and `beta` is on the log scale.
    """
    pad = F.when(F.least(*COUNTS) == 0, 0.5).otherwise(0.0)
    rates = df.withColumn("_pad", pad).withColumns(
        {
            "hr": (F.col("hits") + F.col("_pad")) / (F.col("hits") + F.col("misses") + 2 * F.col("_pad")),
            "fr": (F.col("false_alarms") + F.col("_pad"))
            / (F.col("false_alarms") + F.col("correct_rejections") + 2 * F.col("_pad")),
        }
    )
    scored = rates.withColumns({"_zh": qnorm("hr"), "lambda": qnorm("fr")})
    scored = scored.withColumn("d", F.col("_zh") - F.col("lambda"))
    return scored.withColumns(
        {"ccrit": (F.col("_zh") + F.col("lambda")) / 2, "beta": F.col("d") * (-F.col("lambda") - F.col("d") / 2)}
    ).drop("_pad", "_zh")


def sdt(trials: DataFrame, keys=(*PARTICIPANT, "bias_direction")) -> DataFrame:
    return with_sdt(confusion_counts(trials, keys))
