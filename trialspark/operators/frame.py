"""Projections, filters and category columns on trial tables."""

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import column
from ..functions.text import paste
from ..schema import DESIGN, DIRECTIONS, LEVELS, SOURCES


def by_task(df: DataFrame, task: str) -> DataFrame:
    return df.where(F.col("trial_type") == task)


def nonzero(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) != 0)


def parse_abs(col) -> Column:
    """Magnitude of a number held as text; NULL for text that is not a number."""
    return F.abs(column(col).try_cast("double"))


def is_present(col, strict=True) -> Column:
    """1 for `present`, 0 for `absent`. Other words give NULL when strict, else 0 (NULL stays NULL)."""
    col = column(col)
    if strict:
        return F.when(col == "present", 1).when(col == "absent", 0)
    return (col == "present").cast("int")


def accuracy(level, answer) -> Column:
    """Whether a detection answer is right; anything unknown counts as wrong."""
    level, answer = column(level), column(answer)
    right = ((level == "absent") & (answer == "absent")) | (level.isin("low", "high") & (answer == "present"))
    return F.coalesce(right, F.lit(False))


def confusion_key(acc, answer) -> Column:
    return paste(F.lower(column(acc).cast("string")), answer, sep="_")


def with_order(df: DataFrame, col: str, levels) -> DataFrame:
    """Ordered category: adds `<col>_ord` counted from 1; values outside the levels become NULL in both columns."""
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(col))
    known = F.when(position > 0, position.cast("int"))
    return df.withColumn(f"{col}_ord", known).withColumn(col, F.when(F.col(f"{col}_ord").isNotNull(), F.col(col)))


def condition_codes(df: DataFrame, sep="\n") -> DataFrame:
    """Composite condition and stimulus codes, all four category columns ordered for presentation."""
    coded = df.withColumns(
        {
            "condition_code": paste("bias_source", "bias_direction", sep=sep),
            "stim_code": paste("bias_direction", "contrast_level", sep=sep),
        }
    )
    sources = sorted(SOURCES)
    coded = with_order(coded, "condition_code", [sep.join(pair) for pair in product(sources, DIRECTIONS)])
    coded = with_order(coded, "stim_code", [sep.join((d, level)) for level, d in product(LEVELS, DIRECTIONS)])
    return with_order(with_order(coded, "bias_source", SOURCES), "contrast_level", LEVELS)


def model_frame(trials: DataFrame) -> DataFrame:
    """Reproduction trials as model input: stimulus, response and condition per participant."""
    return by_task(trials, "reproduction").select(
        "experiment",
        "participant",
        "bias_source",
        F.col("bias_direction").alias("cond"),
        "contrast_level",
        F.abs("target_contrast").alias("stim"),
        parse_abs("answer").alias("response"),
    )


def design_rows(frame: DataFrame) -> DataFrame:
    """The distinct stimuli each participant saw in each condition."""
    return frame.select(*DESIGN).distinct()


def stack(*dfs: DataFrame) -> DataFrame:
    """Rows of all tables by column name; absent columns become NULL."""
    first, *rest = dfs
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
