"""Exact order statistics inside groups of any size.

A window over a group puts the whole group into one task. Here the values of a large group are cut into parts at
approximate quantiles; ranks inside a part are shifted by the sizes of the parts before it. The part is an expression of
group and value, so nothing has to be stored. Groups are held as a struct, which compares missing keys as equal in joins
and windows alike.
"""

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import lookup_join

# Rows of a group that one task may order.
PART_ROWS = 1_000_000


def _parts(df, keys, value, part_rows, largest):
    """The column `_part` for every row; equal values of a group share it."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if largest is None:
        largest = sizes.agg(F.max("_rows")).first()[0] or 0
    if largest <= part_rows:
        return df.withColumn("_part", F.lit(0))
    cuts = ceil(largest / part_rows)
    crowded = lookup_join(df, sizes.where(F.col("_rows") > part_rows), keys, "inner")
    quantiles = F.percentile_approx(value, [i / cuts for i in range(1, cuts)] or [0.5], 10 * max(cuts, 1000))
    bounds = crowded.groupBy(*keys).agg(quantiles.alias("_bounds"))
    placed = lookup_join(df, bounds, keys)
    below = F.size(F.filter("_bounds", lambda bound: bound < F.col(value)))
    return placed.withColumn("_part", F.when(F.col("_bounds").isNull(), 0).otherwise(below)).drop("_bounds")


def place_values(df: DataFrame, keys, value, by=(), weight=None, part_rows=PART_ROWS, largest=None, **extra) -> DataFrame:
    """The distinct values of each group with their `count`, and the part of the group they belong to.

    Rows are told apart by `by` as well. `weight` names a column that says how many rows each input row stands for;
    `extra` aggregates are computed on the way. NULL values are left out. `largest`: rows of the largest group, if known.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    aggregates = [rows.alias("count"), *[agg.alias(name) for name, agg in extra.items()]]
    distinct = df.where(F.col(value).isNotNull()).groupBy(*keys, value, *by).agg(*aggregates)
    placed = _parts(distinct, keys, value, part_rows, largest)
    return placed.withColumn("_group", F.struct(*keys)).drop(*keys)


def _offsets(placed):
    """Rows of the group before each partition, in it, and in all. At most one row per group and partition."""
    parts = placed.groupBy("_group", "_part").agg(F.sum("count").alias("_size"))
    group = Window.partitionBy("_group")
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    return parts.select("_group", "_part", before.alias("_before"), F.sum("_size").over(group).alias("total"), "_size")


def _located(placed, offsets, value):
    """Adds `n` and `below`; windows and join share one partitioning by group and partition."""
    inside = Window.partitionBy("_group", "_part")
    up_to = inside.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.withColumn("_up_to", F.sum("count").over(up_to)).withColumn(
        "n", F.sum("count").over(Window.partitionBy("_group", "_part", value))
    )
    joined = ranked.join(offsets.drop("_size"), ["_group", "_part"])
    below = F.col("_before") + F.col("_up_to") - F.col("n")
    return joined.withColumn("below", below).drop("_up_to", "_before")


def _unpacked(df):
    return df.select("_group.*", *[c for c in df.columns if c not in ("_group", "_part")])


def rank_placed(placed: DataFrame, value) -> DataFrame:
    """Placed values with `n` rows of the value, `below` rows of smaller ones and `total` rows in the group."""
    return _unpacked(_located(placed, _offsets(placed), value))


def ordered_counts(df: DataFrame, keys, value, by=(), weight=None, **extra) -> DataFrame:
    """Distinct values per group with `n`, `below` and `total`; see `place_values` for the arguments."""
    return rank_placed(place_values(df, keys, value, by, weight, **extra), value)


def avg_rank():
    """Average rank of tied values, on the output of `ordered_counts`."""
    return F.col("below") + (F.col("n") + 1) / 2.0


def median_of_placed(placed: DataFrame, value, name="median") -> DataFrame:
    """Interpolating median per group; only the partitions that hold a middle position are looked into."""
    low, high = F.floor((F.col("total") + 1) / 2.0), F.floor(F.col("total") / 2.0) + 1
    middle = _offsets(placed).where((F.col("_before") < high) & (low <= F.col("_before") + F.col("_size")))
    nearby = placed.join(middle.select("_group", "_part"), ["_group", "_part"])
    located = _located(nearby, middle, value)
    reach = F.col("below") + F.col("n")

    def at(position):
        return F.max(F.when((F.col("below") < position) & (position <= reach), F.col(value)))

    medians = located.groupBy("_group").agg(((at(low) + at(high)) / 2.0).alias(name))
    return medians.select("_group.*", name)


def exact_median(df: DataFrame, keys, value, name="median", **placing) -> DataFrame:
    return median_of_placed(place_values(df, keys, value, **placing), value, name)
