"""Result tables stored per key, and jobs that skip the keys already stored."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.joins import missing_keys
from ..schema import MODEL_BF, PREDICTIVE, RHAT
from .trials import CSV


def read_many(spark: SparkSession, path: str, schema: T.StructType, pattern="*.csv") -> DataFrame:
    """All matching files of a folder stacked; the key columns are in their rows. The headers must list the schema's names
    in order: result files are written by programs."""
    return spark.read.schema(schema).option("enforceSchema", False).options(**CSV, pathGlobFilter=pattern).csv(path)


def read_rhat(spark: SparkSession, path: str, pattern="*.csv") -> DataFrame:
    """R-hat tables: quoted parameter names may hold commas, `NA` is missing."""
    return read_many(spark, path, RHAT, pattern)


def read_model_bf(spark: SparkSession, path: str, pattern="*.csv") -> DataFrame:
    return read_many(spark, path, MODEL_BF, pattern)


def read_predictive(spark: SparkSession, path: str, fmt="parquet") -> DataFrame:
    return spark.read.schema(PREDICTIVE).format(fmt).load(path)


def write_keyed(df: DataFrame, path: str, keys, fmt="parquet") -> None:
    """One folder per key. Only the keys present in `df` are replaced; other stored keys stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).format(fmt).save(path)


def stored_keys(spark: SparkSession, path: str, keys, schema: T.StructType, fmt="parquet") -> DataFrame:
    """Keys with a stored result; none if the folder does not exist yet."""
    try:
        return spark.read.schema(schema).format(fmt).load(path).select(*keys).distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([schema[k] for k in keys]))


def compute_missing(todo: DataFrame, path: str, keys, schema, compute: Callable[[DataFrame], DataFrame], fmt="parquet") -> None:
    """Run `compute` on the keys of `todo` without a stored result and store what it returns."""
    done = stored_keys(todo.sparkSession, path, keys, schema, fmt)
    write_keyed(compute(missing_keys(todo, done, keys)), path, keys, fmt)


