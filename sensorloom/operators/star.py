"""Joins of readings with their dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import times as T
from ..schemas import need

CORE = ["Equipment", "Description", "DateTime", "CurrValue"]


def located(dim: DataFrame, longlat: DataFrame) -> DataFrame:
    """Sensors with the place of their station, all of them; keys compare as text. The place's name is ``GeoLocation``."""
    need(dim, "RTUNumber")
    need(longlat, "LKey")
    places = longlat.select(F.col("LKey").cast("string").alias("LKey"), "Longitude", "Latitude", F.col("Location").alias("GeoLocation"))
    return dim.join(places, F.col("RTUNumber").cast("string") == F.col("LKey"), "left").drop("LKey")


def readings(inst: DataFrame, links: DataFrame, dim: DataFrame) -> DataFrame:
    """The detector's input: readings joined to their keys and dimensions, the core columns first.

    Keys have no nulls by then, so plain equality is right. Which side is broadcast is left to Spark, by size.
    """
    need(dim, "Hkey", "Equipment", "Description")
    rows = inst.select("HkeyDateTime", "CurrValue").join(links, "HkeyDateTime").join(dim, "Hkey")
    if dict(rows.dtypes)["DateTime"] == "string":
        rows = rows.withColumn("DateTime", T.parsed(X.collapsed(F.col("DateTime"))))
    rows = rows.withColumn("CurrValue", F.expr("try_cast(CurrValue AS double)"))
    rows = rows.withColumn("CurrValue", F.when(~F.isnan("CurrValue"), F.col("CurrValue")))
    return rows.na.drop(subset=["DateTime", "CurrValue"]).select(*CORE, *[c for c in rows.columns if c not in CORE])


def only_keys(df: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(chosen.select(*keys), keys, "left_semi")


def not_keys(df: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(chosen.select(*keys), keys, "left_anti")


def with_mark(df: DataFrame, chosen: DataFrame, keys: list[str], out: str) -> DataFrame:
    """All rows, and whether their key is among the chosen ones."""
    return df.join(chosen.select(*keys).distinct().withColumn(out, F.lit(True)), keys, "left").withColumn(out, F.coalesce(out, F.lit(False)))
