"""Session defaults, lineage cuts and partition sizing."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every session of this engine wants; a cluster sets its own sizes.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoints that nothing refers to any more are deleted.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the engine's defaults, for tests and benchmarks."""
    builder = SparkSession.builder.master(master).appName("heddle")
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    ``spark.checkpoint.dir`` of the session is used where it is set.  Where
    neither it nor the context has a folder, a temporary one is made for a
    local master, whose executors share this machine; on a cluster that is an
    error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="heddle-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the copy.

    The copy is on storage that all executors share, so losing an executor
    costs a re-read and no recomputation.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """How many partitions explicit repartitionings use."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Tables up to this size are dealt out to all cores where few row groups would leave most of them idle.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over all cores by ``keys`` if it is small; a large one has splits enough and stays as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys) if size <= SMALL_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
