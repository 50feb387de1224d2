"""Session settings the plans rely on; everything else is left to the cluster."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Runtime (non-static) settings. Skewed join keys are split by the adaptive planner, also where
# the split costs one more exchange; results never depend on any of these.
_RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans here read kept tables; their descriptions would repeat each other without a bound.
    "spark.sql.maxPlanStringLength": "200000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime options on ``spark`` and return it."""
    for key, value in _RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable: the cluster's shared folder, or one for tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        import tempfile

        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)


def keep(df: DataFrame) -> DataFrame:
    """A table that is read several times: written once to the shared folder, nothing stays persisted."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """A table that a loop reads again: ``keep`` as files, whose size is known.

    A checkpoint inherits the size estimated for its plan, a product over the joins. From round to round the
    number of its digits multiplies, until the planner's numbers alone fill the driver.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give heavy per-row work to every core when the scan is smaller than the cluster.

    A table of a few row groups scans in a few tasks; a large one already has more partitions
    than cores and is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
