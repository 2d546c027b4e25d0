"""Session helpers shared by every operator: settings, checkpoints, table access."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "cartoweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; an existing session is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # checkpoints of frames that nothing refers to are deleted
    } | conf
    return builder.config(map=settings).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` is used where the cluster names one. Only in local mode, where all tasks share this machine, a
    temporary folder is made where it is unset; on a cluster that is an error, as executors would not see each other's files.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None:
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cartoweave-checkpoint-"))
    return named or sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for work that is heavy per row.

    A table of one small file would else run in one task. Larger tables have more partitions than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
