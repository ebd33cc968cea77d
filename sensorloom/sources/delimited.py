"""Delimited text with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import without_markers

NOTHING = "\u0000"


def read_csv(spark: SparkSession, paths: str | list[str], schema: StructType, *, sep: str = ",", malformed: str = "PERMISSIVE", keep_empty: bool = False, time_format: str | None = None) -> DataFrame:
    """Files with a header each, read as one scan; column names must be those of the schema.

    ``malformed``: DROPMALFORMED skips rows that do not fit, FAILFAST raises, PERMISSIVE gives nulls.
    ``keep_empty``: text is taken as it stands, empty text stays empty; otherwise markers of missing values are null.
    """
    reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", malformed).option("enforceSchema", False)
    if time_format:
        reader = reader.option("timestampNTZFormat", time_format).option("timestampFormat", time_format)
    if keep_empty:
        texts = [f.name for f in schema if f.dataType.simpleString() == "string"]
        return reader.option("nullValue", NOTHING).option("emptyValue", "").csv(paths).na.fill("", subset=texts)
    return without_markers(reader.csv(paths))


def read_texts(spark: SparkSession, paths: str | list[str], names: list[str], *, sep: str = ",") -> DataFrame:
    """All columns as text, for casts that may fail one by one."""
    return read_csv(spark, paths, StructType([StructField(n, StringType()) for n in names]), sep=sep)


def cast_or_null(df: DataFrame, **kinds: str) -> DataFrame:
    """What can't be cast is null, and so is NaN."""
    out = {}
    for c, kind in kinds.items():
        x = F.expr(f"try_cast(`{c}` AS {kind})")
        out[c] = F.when(~F.isnan(x), x) if kind in ("double", "float") else x
    return df.withColumns(out)


def merged_export(df: DataFrame, path: str, *, sep: str = ",") -> None:
    """One file with one header, for readers that want it; a day's window is small enough for one task."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_table(df: DataFrame, path: str, *, as_csv: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrites a table, also with no rows, so that none of an older run stays."""
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.option("header", True).csv(path) if as_csv else writer.parquet(path)
