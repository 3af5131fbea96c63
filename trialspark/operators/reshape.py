"""Long and wide forms."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def widen(df: DataFrame, ids, names, values, levels, fill=None) -> DataFrame:
    """One column per listed level of `names`. A key with two rows for one level is an error, not a silent choice."""
    aggs = []
    for level in levels:
        hit = F.col(names) == level
        picked = F.max(F.when(hit, F.col(values)))
        checked = F.when(F.count_if(hit) > 1, F.raise_error(F.lit(f"duplicate rows for {names}={level}"))).otherwise(picked)
        aggs.append((checked if fill is None else F.coalesce(checked, F.lit(fill))).alias(level))
    return df.groupBy(*ids).agg(*aggs)


def lengthen(df: DataFrame, ids, cols, names="name", values="value") -> DataFrame:
    """One row per listed column, NULLs kept."""
    return df.unpivot(list(ids), list(cols), names, values)


def unpack(df: DataFrame, struct: str) -> DataFrame:
    """Fields of a struct column as columns."""
    others = [c for c in df.columns if c != struct]
    return df.select(*others, f"{struct}.*")


def picked(names: str, level: str, value) -> Column:
    """Aggregate: the value held for one level of a category."""
    return F.max(F.when(F.col(names) == level, value))


def pair_diff(df: DataFrame, keys, a, b, value, by="bias_direction", name="diff") -> DataFrame:
    """Difference `b - a` within each key; NULL when either side is missing."""
    return (
        df.groupBy(*keys)
        .agg(picked(by, a, F.col(value)).alias(a), picked(by, b, F.col(value)).alias(b))
        .withColumn(name, F.col(b) - F.col(a))
    )


def diff_by_measure(df: DataFrame, keys, measures, by="cond", a="control", b="present") -> DataFrame:
    """Effect `b - a` of every measure, one column each."""
    return df.groupBy(*keys).agg(
        *[(picked(by, b, F.col(m)) - picked(by, a, F.col(m))).alias(m) for m in measures]
    )
