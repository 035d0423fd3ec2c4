"""Session helpers.

The library never creates a session behind the user's back for real work; ``get_spark``
is a convenience for tests, the bench and the driver contract.  Lineage in iterative
operators is cut with ``DataFrame.checkpoint()`` into the shared folder named by
``spark.checkpoint.dir``; a default is set only when the session has none.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "loupe") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app_name)
    master = master or os.environ.get("LOUPE_MASTER")
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("LOUPE_DRIVER_MEMORY", "16g")))
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared checkpoint folder.  Where none is named, a local session (one
    machine, as in tests) gets a scratch folder; on a cluster that is an error, since executors do
    not share a machine's temporary folder."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    d = d or sc.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="loupe-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, what: str = "stage", file_rows: int = 0) -> DataFrame:
    """Write a table once to a new folder under the shared checkpoint folder and read it back: later
    steps all see the same rows, and a lost executor costs no recomputation.  A file has at most
    ``file_rows`` rows (0: any number), as a reader may hold many rows of a file at once.  As with
    checkpoint files, the folder's owner clears it."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/loupe-{what}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
