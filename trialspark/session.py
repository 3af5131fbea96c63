"""Session settings and durable intermediate tables."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores="*", partitions=8, memory="8g") -> SparkSession:
    """A session for tests and benchmarks; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trialspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir` if the session names one.

    Only when it is unset do we pick one: a temporary folder in local mode, otherwise a folder in the warehouse, which then
    must be on a shared file system; a warehouse on each machine's own disk is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if configured is None:
            if sc.master == "local" or sc.master.startswith("local["):
                configured = tempfile.mkdtemp(prefix="trialspark-")
            else:
                warehouse = spark.conf.get("spark.sql.warehouse.dir")
                if warehouse.startswith(("file:", "/")):
                    raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the warehouse {warehouse} is local")
                configured = warehouse.rstrip("/") + "/_trialspark"
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to reliable storage and cut its lineage there, so a lost executor costs no recomputation.

    Used where a table is read several times, or where a later step must see exactly the same rows twice.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
