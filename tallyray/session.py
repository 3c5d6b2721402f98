"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Session settings every job relies on.  AQE re-plans joins at runtime
# (broadcast when the measured side is small, split skewed partitions,
# coalesce tiny shuffle partitions); UTC keeps block-time derivations stable.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # call-site capture costs several driver round trips for every column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "tallyray",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.ui.enabled", "false")
    conf.setdefault("spark.driver.memory", os.environ.get("TALLYRAY_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Read from ``spark.checkpoint.dir``; only when the session has none (local
    tests) a scratch folder is created and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tallyray-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def state_root(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for versioned state tables."""
    return os.path.join(checkpoint_dir(spark), name)


def reliable_checkpoint(df):
    """``df.checkpoint()`` into the shared checkpoint folder without computing
    ``df`` twice: Spark writes a checkpoint by re-running the plan unless the
    data is persisted, so it is persisted for the duration of the write."""
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


def tasks_for(rows: int) -> int:
    """How many tasks sort ``rows`` wide rows: from 50,000 rows each, 1,250,000 at most.

    Left to itself AQE joins partitions by their compressed bytes; sorted ones hold several times as many, and spill.
    Up to 200 partitions Spark writes a shuffle without sorting it, so there are more only for more than 250 million rows.
    """
    return max(1, -(-rows // 1_250_000), min(200, -(-rows // 50_000)))


def stored(df, name: str):
    """``df`` written once as parquet into the shared checkpoint folder and read
    back: later plans read only the columns they use, survive executor loss and
    take a fraction of a checkpoint's bytes, whose rows are not encoded."""
    import uuid
    path = os.path.join(checkpoint_dir(df.sparkSession), "tables", f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
