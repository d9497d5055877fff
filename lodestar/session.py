"""Spark session set-up and shared scratch locations.

Scratch data (checkpoints, CSV round trips, materialised tables) always goes
under the folder the cluster names in ``spark.checkpoint.dir``.  Only when that
setting is absent (local tests) do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_spark(master: str | None = None, app: str = "lodestar",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings every job here relies on.

    AQE is on (runtime coalescing, skew-join splitting, broadcast demotion);
    the UI is off; timestamps are UTC so results match the SQL oracle.  A
    setting that the cluster gives is left as it is.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    given = dict(SparkConf().getAll())                     # what spark-submit or the cluster set
    ours = {
        "spark.master": master or f"local[{cpus}]", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if "spark.master" not in given:                        # a local run: sized for this machine
        ours |= {"spark.sql.shuffle.partitions": str(shuffle_partitions or int(cpus)),
                 "spark.driver.memory": os.environ.get("LODESTAR_DRIVER_MEM", "16g")}
    builder = SparkSession.builder.appName(app)
    for key, value in ours.items():
        if key not in given:
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only if unset."""
    current = spark.conf.get(_CHECKPOINT_KEY, None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="lodestar-ckpt-")
        spark.conf.set(_CHECKPOINT_KEY, current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared scratch folder for one materialisation."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def scratch_root(spark: SparkSession) -> str:
    """Where this application's materialisations lie, in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/lodestar-scratch/{spark.sparkContext.applicationId}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete what this application has materialised; frames read from it are gone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
