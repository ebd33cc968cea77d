"""Events, sensor summaries and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent
from ..functions.text import safe_name
from ..schemas import need
from .quantiles import exact_quantiles
from .runs import run_values, runs_of

KEYS = ["Equipment", "Description"]
SUMMARY = [
    "Equipment", "Description", "Total_Points", "Anomaly_Points", "Anomaly_Pct", "Num_Events", "First_Anomaly_Time", "Last_Anomaly_Time", "Z_Points", "ISO_Points", "DTW_Points", "Peak_RZ", "Max_DTW_Dist",
    "Mean_Value", "Median_Value", "Plot_Path", "Longitude", "Latitude", "Location",
]


def count_true(column: str):
    return F.count_if(F.col(column))


def event_table(points: DataFrame, keys: Sequence[str] = KEYS, flag: str = "Combined_Anomaly") -> DataFrame:
    """One row for each run of anomalous points."""
    rows = run_values(
        points, runs_of(points, keys, flag), keys,
        [
            F.min("DateTime").alias("Start_Time"), F.max("DateTime").alias("End_Time"), F.count("*").alias("Duration_pts"), F.min_by("CurrValue", "rn").alias("First_Value"), F.max_by("CurrValue", "rn").alias("Last_Value"),
            F.max(F.abs("RZ")).alias("Max_RZ"), count_true("Z_Flag").alias("Z_Points"), count_true("ISO_Flag").alias("ISO_Points"), count_true("DTW_Flag").alias("DTW_Points"), F.bool_or("Rule_Based_Invalid").alias("Rule_Invalid_In_Event"),
        ],
    )
    return rows.drop("s", "e")


def sensor_summary(points: DataFrame, output_dir: str | None = None, keys: Sequence[str] = KEYS, flag: str = "Combined_Anomaly") -> DataFrame:
    """One row for each sensor with anomalies, in 19 columns; the place is that of the sensor's first row. ``points`` is read several times, so it should be a written table or cheap."""
    need(points, *keys, flag, "rn", "CurrValue", "RZ", "DTW_Dist")
    bad = F.col(flag)
    on = lambda c: F.when(bad, c)
    place = {c: F.min_by(c, "rn") if c in points.columns else F.lit(None).cast(kind) for c, kind in (("Longitude", "double"), ("Latitude", "double"), ("Location", "string"))}
    rows = points.groupBy(*keys).agg(
        F.count("*").alias("Total_Points"), F.count_if(bad).alias("Anomaly_Points"), F.min(on(F.col("DateTime"))).alias("First_Anomaly_Time"), F.max(on(F.col("DateTime"))).alias("Last_Anomaly_Time"),
        F.count_if(bad & F.col("Z_Flag")).alias("Z_Points"), F.count_if(bad & F.col("ISO_Flag")).alias("ISO_Points"), F.count_if(bad & F.col("DTW_Flag")).alias("DTW_Points"),
        F.max(on(F.abs("RZ"))).alias("Peak_RZ"), F.max(on(F.col("DTW_Dist"))).alias("Max_DTW_Dist"), F.avg("CurrValue").alias("Mean_Value"),
        *[v.alias(c) for c, v in place.items()],
    ).filter("Anomaly_Points > 0")
    events = runs_of(points, keys, flag).groupBy(*keys).agg(F.count("*").alias("Num_Events"))
    # ``percentile`` would keep all values of a series in one task's map.
    medians = exact_quantiles(points, keys, {"Median_Value": (F.col("CurrValue"), 0.5)})
    rows = rows.join(events, list(keys)).join(medians, list(keys)).withColumn("Anomaly_Pct", percent(F.col("Anomaly_Points"), F.col("Total_Points")))
    path = F.lit("") if output_dir is None else F.concat(F.lit(output_dir.rstrip("/") + "/"), safe_name(*[F.col(k) for k in keys]))
    return rows.withColumn("Plot_Path", path).select(*[c for c in SUMMARY if c in [*rows.columns, "Plot_Path"]])


def methods_used(summary: DataFrame) -> DataFrame:
    used = sum((F.col(c) > 0).cast("int") for c in ("Z_Points", "ISO_Points", "DTW_Points"))
    return summary.withColumn("Methods_Used", used)


def top_sensors(summary: DataFrame, *, most: int = 10, methods: int = 2, keys: Sequence[str] = KEYS) -> DataFrame:
    """The most anomalous sensors that enough methods agree on; ties go by name."""
    rows = methods_used(summary).filter((F.col("Methods_Used") >= methods) & (F.col("Num_Events") > 0))
    return rows.orderBy(F.desc("Methods_Used"), F.desc("Anomaly_Pct"), F.desc("Peak_RZ"), *keys).limit(most)


def by_anomalies(summary: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return summary.orderBy(F.desc("Anomaly_Points"), *keys)


def totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("abnormal_sensors"), F.coalesce(F.sum("Num_Events"), F.lit(0)).alias("events"))


def sensor_locations(readings: DataFrame, order: Sequence[str] = ("DateTime",), keys: Sequence[str] = KEYS) -> DataFrame:
    """Each sensor's place as of its first row; columns that are absent are null."""
    have = [c for c in ("Longitude", "Latitude", "Location") if c in readings.columns]
    kinds = {"Longitude": "double", "Latitude": "double", "Location": "string"}
    first = F.struct(*order)
    return readings.na.drop(subset=list(keys)).groupBy(*keys).agg(*[F.min_by(c, first).alias(c) if c in have else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])


def location_map(locations: DataFrame, abnormal: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The data of a map: all placed sensors, and which of them are abnormal."""
    placed = locations.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in ("Longitude", "Latitude")}).na.drop(subset=["Longitude", "Latitude"])
    return placed.join(abnormal.select(*keys).distinct().withColumn("is_abnormal", F.lit(True)), list(keys), "left").withColumn("is_abnormal", F.coalesce("is_abnormal", F.lit(False)))


def series_plot(points: DataFrame, chosen: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The data of the chosen sensors' plots: their points with the flags."""
    return points.join(chosen.select(*keys), list(keys), "left_semi").select(*keys, "DateTime", "CurrValue", "Z_Flag", "ISO_Flag", "DTW_Flag", "Rule_Based_Invalid", "Combined_Anomaly")
