"""Tables between jobs, in the folder that the cluster shares.

A written table cuts the lineage and survives the loss of executors, which a local checkpoint
doesn't. The folder is ``spark.checkpoint.dir`` of the session; only a session in local mode
without one gets a folder of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local["):
        folder = "file:///tmp/checkpoints/skeinlab"
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def write_table(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skeinlab-{uuid.uuid4().hex}/{name}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._skeinlab_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of write_table() that no plan needs any longer."""
    path = getattr(df, "_skeinlab_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p.getParent(), True)
