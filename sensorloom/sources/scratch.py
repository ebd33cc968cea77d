"""Tables that a plan reads more than once, written to the folder that the cluster shares."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. A local session that names none gets a folder; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _local_folder()
    return folder.rstrip("/")


@functools.lru_cache(maxsize=1)
def _local_folder() -> str:
    os.makedirs("/tmp/checkpoints", exist_ok=True)
    return tempfile.mkdtemp(prefix="sensorloom-", dir="/tmp/checkpoints")


#: Tables written since each ``temporary`` that is open began.
_owned: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at the end. What is read from them must be used up, or written with ``keep``, by then."""
    _owned.append([])
    try:
        yield
    finally:
        for path in _owned.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, keep: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """The same rows, computed once. ``keep``: the table outlives the innermost ``temporary``, but not one around it.

    ``by``: columns of few values; a reader that filters by them only reads the files of those values.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for owner in _owned[:-1][-1:] if keep else _owned[-1:]:
        owner.append(path)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[F.col(f"`{c}`") for c in df.columns])
