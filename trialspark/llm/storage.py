"""Intermediate tables in the folder that all executors share."""

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet below the shared folder and read it back.

    The files cut the lineage and survive the loss of an executor. They are compressed and read by column, so several
    later steps can use one of them cheaply. They stay until `clear`, or until the cluster cleans its checkpoint folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


_MADE: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete the tables that `store` wrote in this process; results that still read them become unusable."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)


def columns(df: DataFrame) -> dict:
    """A small table as numpy arrays by column name; fetched as Arrow batches, without a Python object per row."""
    table = df.toArrow()
    return {name: table.column(name).to_numpy() for name in table.column_names}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
