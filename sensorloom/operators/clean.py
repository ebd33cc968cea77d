"""Cleaning of the exports into a small star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import times as T
from ..schemas import need

#: Station numbers by part of the tag and by pattern of the description, in the order in which they overwrite.
STATION_TAGS = (("S606-KAL", 1001), ("S606-PEL", 1003), ("S606-ALEX", 1002), ("S606-JLNRJH", 1004), ("S606-THM", 1005), ("S606-GEY", 1006))
STATION_PATTERNS = (("(?i)rajah", 1004), ("(?i)marinarwps", 1007), ("KranjiIPU.*CNF", 4221))


def dimension(histcurr: DataFrame) -> DataFrame:
    """Sensors: station number by rules, location, key, kind of signal and class of equipment."""
    need(histcurr, "TAGNAME", "IPADDRESS", "ROW_ID", "DESCRIPTION", "RAWTYPE", "RTUNUMBER")
    rows = histcurr.na.drop("any")
    rules = [(F.contains("TAGNAME", F.lit(tag)), number) for tag, number in STATION_TAGS] + [(F.rlike("DESCRIPTION", F.lit(p)), number) for p, number in STATION_PATTERNS]
    rows = rows.select(
        F.col("IPADDRESS").cast("long").alias("IPAddress"), F.col("ROW_ID").cast("long").alias("RowId"), F.col("DESCRIPTION").alias("Description"), F.col("TAGNAME").alias("Tagname"),
        X.last_match(F.col("RTUNUMBER").cast("long"), rules).cast("long").alias("RTUNumber"), F.col("RAWTYPE").cast("long").alias("RawType"),
    )
    rows = rows.withColumns({"Location": X.before_first(F.col("Description")), "Hkey": hkey("IPAddress", "RowId"), "Signaltype": X.signal_type(F.col("RawType"))})
    return rows.withColumn("Equipment", X.equipment(F.col("Description"), F.col("Signaltype")))


def hkey(address: str, row: str):
    """Both numbers without a separator, as the exports' other tables have it; (1, 23) and (12, 3) are alike."""
    return F.concat(F.col(address).cast("string"), F.col(row).cast("string"))


def instances(history: DataFrame, limit: float = 1e9) -> DataFrame:
    """Readings of a plausible size with their keys."""
    need(history, "IPADDRESS", "ROW_ID", "DATETIME", "CURRVALUE")
    rows = history.na.drop("any").filter((F.col("CURRVALUE") < limit) & (F.col("CURRVALUE") > -limit))
    rows = rows.select(hkey("IPADDRESS", "ROW_ID").alias("Hkey"), F.col("DATETIME").alias("DateTime"), F.col("CURRVALUE").alias("CurrValue"))
    return rows.withColumn("HkeyDateTime", F.concat("Hkey", T.compact(F.col("DateTime"))))


def alarms(histalmevt: DataFrame, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(alarms of the last days before the newest one, rows whose text has no status). A text is a name, a space and a status."""
    need(histalmevt, "ALARMSETTIME", "ALARMTEXT")
    rows = histalmevt.na.drop("any").withColumn("_text", X.stripped(F.col("ALARMTEXT")))
    bad = rows.filter(~F.contains("_text", F.lit(" "))).drop("_text")
    rows = rows.filter(F.contains("_text", F.lit(" ")))
    rows = rows.select(F.col("ALARMSETTIME").alias("DateTime"), X.before_last_space(F.col("_text")).alias("Hkey"), X.after_last_space(F.col("_text")).alias("Status"))
    rows = since_newest(rows, "DateTime", hours=24 * days)
    rows = rows.withColumn("Status", F.when(F.rlike("Status", F.lit(r"\bStop\b")), F.lit("Stopped")).otherwise(F.col("Status")))
    return rows.withColumn("HkeyDateTime", X.digits_only(F.concat("Hkey", T.compact(F.col("DateTime"))))), bad


def link_table(alarm_rows: DataFrame, instance_rows: DataFrame) -> DataFrame:
    """Distinct keys of alarms and readings; whatever is no digit goes from the key."""
    columns = ["HkeyDateTime", "DateTime", "Hkey"]
    both = alarm_rows.select(*columns).unionByName(instance_rows.select(*columns))
    return both.withColumn("HkeyDateTime", X.digits_only(F.col("HkeyDateTime"))).distinct()


def date_dimension(links: DataFrame, time: str = "DateTime") -> DataFrame:
    rows = links.select(F.col(time).alias("DateTime")).distinct()
    return rows.select("DateTime", F.to_date("DateTime").alias("Date"), F.hour("DateTime").alias("Hour"), F.minute("DateTime").alias("Minute"))


def since_newest(df: DataFrame, time: str, *, hours: int, inclusive: bool = False) -> DataFrame:
    """Rows of the last hours before the newest row. The bound is one row, so it is broadcast whatever the table's size."""
    bound = df.agg(F.max(time).alias("_newest"))
    from_there = F.col("_newest") - F.expr(f"INTERVAL {hours} HOURS")
    keep = F.col(time).between(from_there, F.col("_newest")) if inclusive else F.col(time) > from_there
    return df.crossJoin(F.broadcast(bound)).filter(keep).drop("_newest")


def without_kinds(df: DataFrame, column: str, kinds: tuple[str, ...]) -> DataFrame:
    """Rows of other kinds; a null kind stays."""
    return df.filter(~F.coalesce(F.col(column).isin(*kinds), F.lit(False)))


def dropped_by_kind(df: DataFrame, column: str, kinds: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """What ``without_kinds`` drops: rows and distinct sensors of each kind."""
    return df.filter(F.col(column).isin(*kinds)).groupBy(column).agg(F.count("*").alias("rows"), F.count_distinct(*keys).alias("sensors"))


def null_counts(df: DataFrame, *columns: str) -> DataFrame:
    """One row: how many rows each column's nulls would drop."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])
