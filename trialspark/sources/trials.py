"""Reading and writing trial tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.frame import stack
from ..schema import TRIALS
from .headers import read_by_header

CSV = {"header": True, "nullValue": "NA", "quote": '"', "escape": '"'}


def _options(fmt):
    return CSV if fmt == "csv" else {}


def without(schema: T.StructType, *names) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in names])


def read_csv(spark: SparkSession, path, schema: T.StructType, required=()) -> DataFrame:
    """Columns are matched to the schema by the names in each file's header, in any order; the headers of the files of a folder
    may differ. Columns that the schema does not name are carried along as text; a value that does not fit its type is
    NULL. An error names `required` columns that a file lacks."""
    raw = read_by_header(spark, path, CSV, required)
    kinds = {f.name: f.dataType for f in schema.fields}
    return raw.select(*[F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in raw.columns])


# What every trial file must have; the order of trials is needed by few operators.
REQUIRED = [f.name for f in TRIALS.fields if f.name not in ("experiment", "trial_index")]


def read_trials(spark: SparkSession, paths: dict, schema: T.StructType = None, index: str = None) -> DataFrame:
    """Raw trials of several experiments stacked, each row tagged with its experiment.

    The types are given, never inferred: ids keep leading zeros and `answer` stays text in every file. `index` names the
    column that holds the order of the trials, which becomes `trial_index`. A file without one is read all the same;
    only operators that need the order (`start_balance`) then fail, for want of that column.
    """
    schema = without(TRIALS, "experiment") if schema is None else schema
    tables = []
    for name, path in paths.items():
        df = read_csv(spark, path, schema, [*REQUIRED, *([index] if index else [])])
        if index and index != "trial_index":
            df = df.withColumn("trial_index", F.col(f"`{index}`").try_cast("long"))
        tables.append(df.withColumn("experiment", F.lit(name)))
    return stack(*tables)


def write_by_experiment(df: DataFrame, path: str, fmt="parquet") -> None:
    """One folder per experiment; the key lives in the folder name."""
    df.write.mode("overwrite").partitionBy("experiment").format(fmt).options(**_options(fmt)).save(path)


def read_filtered(spark: SparkSession, path: str, experiment=None, fmt="parquet") -> DataFrame:
    """Stored trials of all experiments found, with all their columns; naming an experiment reads its folder only."""
    if fmt == "csv":
        df = read_csv(spark, path, TRIALS, REQUIRED)
    else:
        df = spark.read.format(fmt).option("mergeSchema", True).load(path)
    df = df.withColumn("experiment", F.col("experiment").cast("string"))
    return df if experiment is None else df.where(F.col("experiment") == experiment)
