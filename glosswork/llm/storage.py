"""Scratch tables in the folder that the cluster shares.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it back, so a
lost executor costs a re-read, never a recomputation from the start.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of this application below ``spark.checkpoint.dir``; below the warehouse, which is shared too, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/glosswork-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that no other call has been given; nothing is created."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to a scratch table and return a DataFrame that reads it."""
    return materialise_at(df, new_folder(df.sparkSession, name), compression)


def materialise_at(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing will read again."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
