"""Cutting the lineage of plans through the folder that all executors share, and clearing that folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this process writes lies below one folder, so that ``release`` removes it and nothing else.
_RUN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; on a cluster that is an
    error, since executors do not see the driver's disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cloudframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/cloudframe-{_RUN}/{uuid.uuid4().hex}-{label}"


def cut(df: DataFrame, label: str = "rows") -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back.

    What was written survives lost executors, and later steps start from it. It stays until
    ``release``, since results may still read it.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove everything this process has written to the shared folder; results not yet read are lost."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cloudframe-{_RUN}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
