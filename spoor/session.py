"""Session defaults and lineage cutting."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "spoor", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the plans expect; master and partitions are for local runs."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false" if master else "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "12g")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def stage(df: DataFrame) -> DataFrame:
    """Materialise a table that several branches of a plan read.

    Reliable checkpoint in the folder the cluster names in spark.checkpoint.dir,
    so it outlives lost executors.
    """
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables: what spark.checkpoint.dir names.

    A local master may do without and gets a temporary folder; on a cluster a
    machine's own folder would be lost on the others, so a missing name is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()
