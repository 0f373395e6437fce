"""Tables written to the folder that driver and executors share, so that lineage ends and no executor is needed again."""

from __future__ import annotations

import re
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this machine if all of Spark runs on it, and an error otherwise."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not found:
        found = "file:///tmp/checkpoints/recollect"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/") if "://" in found or found.startswith("file:") else "file://" + found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/recollect-{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    PATHS[out] = path
    return out


#: Where staged tables lie.
PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def unstaged(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        delete_folder(df.sparkSession, PATHS.pop(df))


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
