"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`. A temporary folder of this machine stands in only for a local master
    (tests); a cluster without the setting is an error."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), f"terraloom-shared-{os.getuid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/terraloom/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table written to the shared folder and read again: it cuts the lineage, survives
    lost executors, and is columnar. Use delete() on what no later plan needs."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.terraloom_path = path  # type: ignore[attr-defined]
    return out


def delete(*dfs: DataFrame) -> None:
    """Remove tables made by written() that no later plan reads."""
    for df in dfs:
        if path := getattr(df, "terraloom_path", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
