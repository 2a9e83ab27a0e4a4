"""Session settings the operators rely on, and fault-tolerant lineage cuts."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: each can be changed on a running session.
# requireAllClusterKeysForDistribution matters for skew: after a join on text_id Spark would otherwise
# reuse that partitioning for a later grouping on (text_id, start) and leave a very long text in one task.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForDistribution": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above to a running session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session with other settings while something is planned and run."""
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, one under the session's warehouse, on every master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder all executors share (``checkpoint_folder``).

    The files go when their DataFrame is no longer used, if the session sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """Give a file scan with no more splits than cores one partition per core.

    Text is expanded to tokens without a shuffle, so a small file with one row group would run in one task.
    At scale a scan has many more splits than cores and is returned as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() <= cores else scan
