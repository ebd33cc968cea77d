"""Removes generated tables, through Spark's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def remove(spark: SparkSession, paths: list[str], dry_run: bool = True) -> list[str]:
    """The paths that were there; they are deleted unless this is a dry run."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            there.append(p)
            if not dry_run:
                fs.delete(path, True)
    return there
