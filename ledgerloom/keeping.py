"""Tables that several later steps read, kept where every executor finds them again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: the cluster's spark.checkpoint.dir. Where the setting is missing a single machine takes a
    temporary folder; a cluster has no folder that all machines see, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Written once, without its lineage, to the shared folder; Spark's cleaner lets go of it when nobody holds the table
    any more."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Written once to the shared folder by columns, so that later steps read only those they need; gone with the
    application. What Parquet has no type for is checkpointed."""
    if re.search(r"\b(void|interval)\b", df.schema.simpleString()):
        return checkpointed(df)
    spark = df.sparkSession
    folder = new_folder(spark, "kept")
    df.write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)
