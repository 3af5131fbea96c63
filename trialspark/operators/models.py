"""Model evidence: Bayes factors from log evidences, and least-cost fits of the four hurdle models."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import pseudo_log
from ..schema import MODELS, SOURCES
from .frame import with_order

COMPARISONS = {"simple": MODELS, "contrast": ["contrast", "hurdle"]}
MODEL_KEYS = ["experiment", "condition"]


def model_bf(logml: DataFrame, keys=MODEL_KEYS, comparisons=None) -> DataFrame:
    """Log Bayes factor of each model over each denominator it is compared with; `logml` has a row per key and model."""
    comparisons = COMPARISONS if comparisons is None else comparisons
    models = Window.partitionBy(*keys)  # a handful of models per key
    held = logml.withColumns(
        {f"_{d}": F.max(F.when(F.col("model") == d, F.col("logml"))).over(models) for d in comparisons}
    )
    options = F.array(
        *[
            F.when(F.col("model").isin(list(wanted)), F.struct(F.lit(d).alias("denominator"), F.col(f"_{d}").alias("_base")))
            for d, wanted in comparisons.items()
        ]
    )
    rows = held.withColumn("_option", F.explode(F.filter(options, lambda o: o.isNotNull())))
    return rows.select(
        *keys, "model", "_option.denominator", (F.col("logml") - F.col("_option._base")).alias("bf_log")
    )


def rebase(bf: DataFrame, denominator: str, base="simple", keys=MODEL_KEYS) -> DataFrame:
    """The factors over `base` re-expressed over another model."""
    models = Window.partitionBy(*keys)
    over_base = bf.where(F.col("denominator") == base)
    shift = F.max(F.when(F.col("model") == denominator, F.col("bf_log"))).over(models)
    return over_base.withColumn("_shift", shift).select(
        *keys, "model", F.lit(denominator).alias("denominator"), (F.col("bf_log") - F.col("_shift")).alias("bf_log")
    )


def against_baseline(bf: DataFrame, baseline="simple") -> DataFrame:
    """Factors over the baseline model in display order; the baseline itself is not a level, so it drops out."""
    rows = with_order(bf.where(F.col("denominator") == baseline), "condition", SOURCES)
    rows = with_order(rows, "model", [m for m in MODELS if m != baseline])
    return rows.where(F.col("model") != baseline).withColumn("bf_pseudo_log", pseudo_log("bf_log"))


def evidence_label(col):
    """Which model a log factor of hurdle over contrast favours; none at exactly 0."""
    return F.when(F.col(col) < 0, "contrast").when(F.col(col) > 0, "hurdle")


def evidence(bf: DataFrame, denominator="contrast", model="hurdle") -> DataFrame:
    rows = bf.where((F.col("denominator") == denominator) & (F.col("model") != F.col("denominator")))
    rows = rows.where(F.col("model") == model).withColumn("evidence", evidence_label("bf_log"))
    ordered = with_order(rows, "condition", ["payoff", "baserate", "cue"])
    return ordered.withColumn("bf_pseudo_log", pseudo_log("bf_log"))
