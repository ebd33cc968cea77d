"""Hourly exports whose hour stands in the file's name."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.times import hour_floor
from ..schemas import without_markers

STAMP = r"\d{4}[A-Za-z]{3}\d{2}-\d{6}"


class StaleSourceError(RuntimeError):
    """Too many of the expected hours are missing."""


def stamp(name: Column) -> Column:
    """The time in a file's name; null if there is none that can be read."""
    return F.try_to_timestamp(F.regexp_extract(name, f"({STAMP})", 1), F.lit("yyyyMMMdd-HHmmss")).cast("timestamp_ntz")


def matching(names: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """(path, name, stamp) of the paths whose file name begins with the pattern, ends in .csv and has a time."""
    rows = names.select(F.col(path).alias("path"), F.substring_index(F.col(path), "/", -1).alias("name"))
    return rows.filter(F.rlike("name", F.lit(f"^(?:{pattern})")) & F.endswith("name", F.lit(".csv"))).withColumn("stamp", stamp(F.col("name"))).filter(F.col("stamp").isNotNull())


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below a folder, by any file system that Spark reads; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))


def expected_hours(spark: SparkSession, now: datetime, window_hours: int = 72, grace_minutes: int = 30) -> DataFrame:
    """The last hours up to the one that was complete some minutes ago, in order."""
    end = hour_floor(F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {grace_minutes} MINUTES"))
    return spark.range(1).select(F.explode(F.sequence(end - F.expr(f"INTERVAL {window_hours - 1} HOURS"), end, F.expr("INTERVAL 1 HOUR"))).alias("hour"))


def in_window(files: DataFrame, hours: DataFrame) -> DataFrame:
    """Files of the expected hours, in order of time."""
    return files.withColumn("hour", hour_floor(F.col("stamp"))).join(hours, "hour", "left_semi").orderBy("stamp", "path")


def missing_hours(files: DataFrame, hours: DataFrame) -> DataFrame:
    return hours.join(files.select(hour_floor(F.col("stamp")).alias("hour")), "hour", "left_anti").orderBy("hour")


def latest_window(files: DataFrame, hours: int = 72) -> DataFrame:
    """Files of the hours up to the newest file's, inclusive at both ends; superseded by ``in_window``."""
    rows = files.withColumn("hour", hour_floor(F.col("stamp")))
    newest = rows.agg(F.max("hour").alias("_newest"))
    return rows.crossJoin(F.broadcast(newest)).filter(F.col("hour").between(F.col("_newest") - F.expr(f"INTERVAL {hours - 1} HOURS"), F.col("_newest"))).drop("_newest").orderBy("stamp", "path")


def coverage(files: DataFrame, hours: DataFrame) -> DataFrame:
    """One row: hours expected and missing, files found (there can be several an hour), percent missing, first and last hour."""
    found = files.withColumn("hour", hour_floor(F.col("stamp"))).groupBy("hour").agg(F.count("*").alias("files"))
    rows = hours.join(found, "hour", "left")
    out = rows.agg(F.count("*").alias("expected"), F.coalesce(F.sum("files"), F.lit(0)).alias("found"), F.count_if(F.col("files").isNull()).alias("missing"), F.min("hour").alias("start"), F.max("hour").alias("end"))
    return out.withColumn("missing_percent", F.lit(100.0) * F.col("missing") / F.col("expected"))


@dataclass(frozen=True)
class Window:
    paths: list[str]
    info: dict


def gated_window(spark: SparkSession, root: str, pattern: str, now: datetime, *, window_hours: int = 72, grace_minutes: int = 30, max_missing_percent: float = 25.0) -> Window:
    """The paths of the window's files, at most a few an hour; raises when none or too few of them are there."""
    files = matching(list_files(spark, root), pattern)
    hours = expected_hours(spark, now, window_hours, grace_minutes)
    info = coverage(files, hours).first().asDict()
    if not info["found"] or info["missing_percent"] > max_missing_percent:
        raise StaleSourceError(f"{info['missing']} of {info['expected']} hours are missing ({info['missing_percent']:.1f}%; {max_missing_percent:g}% are allowed), {info['found']} files found")
    return Window([r.path for r in in_window(files, hours).select("path").collect()], info)


def newest_by_name(spark: SparkSession, root: str, pattern: str) -> str:
    """The path of the last file by name; raises if there is none."""
    found = list_files(spark, root).filter(F.rlike(F.substring_index("path", "/", -1), F.lit(f"^(?:{pattern})$"))).agg(F.max_by("path", F.substring_index("path", "/", -1))).first()[0]
    if found is None:
        raise FileNotFoundError(f"no file like {pattern} in {root}")
    return found


def decoded_lines(spark: SparkSession, paths: list[str] | str, sep: str = ",") -> DataFrame:
    """(path, number, line) of the records of texts in UTF-8, with or without its mark, or else Latin-1, which takes any byte.

    A line break inside a quoted field ends no record; a quote that does not begin a field, or is never closed, is a character as any other.
    """
    rows = spark.read.format("binaryFile").load(paths)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.regexp_replace(F.coalesce(utf8, F.decode("content", "ISO-8859-1")), "^\uFEFF", "")
    quoted = rf"""(?<![^{re.escape(sep)}\n])"[^"]*+"(?:"[^"]*+")*+"""
    records = F.regexp_extract_all(text, F.lit(rf"""(?:[^"\n]++|{quoted}|")++"""), 0)
    return rows.select("path", F.posexplode(records).alias("number", "line")).withColumn("line", F.regexp_replace("line", "\r$", "")).filter("line <> ''")


def read_decoded(spark: SparkSession, paths: list[str] | str, schema: StructType, *, sep: str = ",", skip_malformed: bool = False) -> DataFrame:
    """Delimited files of either encoding, with a header each, in one scan; the header's names, in its order, must be those of the schema.

    A row that does not fit is nulls where it does not, or is left out."""
    lines = decoded_lines(spark, paths, sep)
    names = sep.join(schema.fieldNames())
    wrong = lines.filter((F.col("number") == 0) & (F.translate("line", '"', "") != names)).select("path").limit(1).collect()
    if wrong:
        raise ValueError(f"the header of {wrong[0].path} is not {names}")
    bad = "_malformed"
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"{bad} string"])
    rows = lines.filter("number > 0").select(F.from_csv("line", F.lit(ddl), {"sep": sep, "columnNameOfCorruptRecord": bad}).alias("r")).select("r.*")
    return without_markers((rows.filter(F.col(bad).isNull()) if skip_malformed else rows).drop(bad))
