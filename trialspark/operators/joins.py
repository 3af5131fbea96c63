"""Equi-joins in which a missing key matches a missing key, with size-checked broadcasts."""

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

# Summary rows hold a handful of scalars (some 200 bytes), so this bounds a broadcast at about 20 MB.
BROADCAST_ROWS = 100_000
# Rows of one key that a task joins at most before its key is salted.
HEAVY_ROWS = 1_000_000


def null_safe_join(left: DataFrame, right: DataFrame, on, how="inner") -> DataFrame:
    """Join on equal or both-missing keys. `<=>` stays an equi-join, so Spark still hashes or sorts on the keys."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in on})
    joined = left.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in on]), how)
    if how == "full":
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(f"_right_{k}")) for k in on})
    return joined.drop(*[f"_right_{k}" for k in on])


def lookup_join(left: DataFrame, right: DataFrame, on, how="left", max_rows=BROADCAST_ROWS, stored=False) -> DataFrame:
    """Join a large table with a summary of unknown size.

    The summary is stored once (unless it comes from a stored table) and its rows are counted: up to `max_rows` it is
    broadcast and the large side does not move; beyond that both sides are shuffled on the keys and adaptive execution
    splits the skewed ones.
    """
    right = right if stored else materialize(right)
    small = right.count() <= max_rows
    return null_safe_join(left, F.broadcast(right) if small else right, on, how)


def exclude_keys(df: DataFrame, bad: DataFrame, keys, max_rows=BROADCAST_ROWS) -> DataFrame:
    """Rows of `df` whose key is not listed in `bad`."""
    return lookup_join(df, bad.select(*keys).distinct(), keys, "left_anti", max_rows)


def merge_cells(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Full outer join of two per-cell summaries."""
    return null_safe_join(a, b, keys, "full")


def salted_join(many: DataFrame, few: DataFrame, on, spread, heavy_rows=HEAVY_ROWS, sizes_of=None, salt=None) -> DataFrame:
    """Inner equi-join of a large table with a small-per-key one, safe when one key holds most rows of `many`.

    The rows of each key of `many` are counted. A key with more than `heavy_rows` is spread over as many sub-keys as it
    needs, by the columns in `spread`, and its rows of `few` are repeated per sub-key; other keys are left alone. `sizes_of`:
    a simpler table with the same rows per key. `salt`: a name under which the sub-key is kept; the rows of a key and sub-key are
    in one task.
    """
    sizes = (many if sizes_of is None else sizes_of).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > heavy_rows)
    salts = materialize(sizes.select(*on, F.ceil(F.col("_rows") / heavy_rows).cast("int").alias("_salts")))
    # A fixed number of partitions: adaptive execution would merge the small inputs of this join, whose output is large.
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if salts.isEmpty():
        joined = many.repartition(parts, *on).join(few, on)
        return joined.withColumn(salt, F.lit(0)) if salt else joined
    n = F.coalesce(F.col("_salts"), F.lit(1))
    left = lookup_join(many, salts, on, stored=True).withColumn("_salt", F.pmod(F.xxhash64(*spread), n).cast("int"))
    right = lookup_join(few, salts, on, stored=True).withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return left.drop("_salts").repartition(parts, *on, "_salt").join(right.drop("_salts"), [*on, "_salt"]).withColumnRenamed("_salt", salt or "_salt").drop("_salt")


def key_grid(df: DataFrame, **levels) -> DataFrame:
    """Every row of `df` with every combination of the listed levels."""
    for name, values in levels.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def literal_grid(spark: SparkSession, **levels) -> DataFrame:
    """The key combinations alone."""
    rows = list(product(*levels.values()))
    return spark.createDataFrame(rows, list(levels))


def missing_keys(todo: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Keys still to be computed: those of `todo` without a stored result in `done`."""
    return exclude_keys(todo, done, keys)
