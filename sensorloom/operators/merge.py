"""Insert-only merges, history snapshots and alert states, on append-only tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import local_now, run_id
from ..schemas import need


@dataclass(frozen=True)
class Merge:
    """How a table takes new rows: by which keys they are new, which columns they have, and whether the source's repeated rows go."""

    keys: tuple[str, ...]
    columns: tuple[str, ...]
    distinct: bool = False


#: The tables of the store.
MERGES: dict[str, Merge] = {
    "alarmevent": Merge(("HkeyDateTime", "Status"), ("HkeyDateTime", "Status"), True),
    "data": Merge(("Equipment", "Description", "DateTime"), ("Equipment", "Description", "DateTime", "CurrValue"), True),
    "dateDim": Merge(("DateTime",), ("DateTime", "Date", "Hour", "Minute")),
    "dim": Merge(("IPAddress", "RowId", "Tagname"), ("IPAddress", "RowId", "Description", "Tagname", "RTUNumber", "RawType", "Location", "Hkey", "Signaltype", "Equipment")),
    "inst": Merge(("HkeyDateTime",), ("HkeyDateTime", "CurrValue"), True),
    "linktable": Merge(("HkeyDateTime", "DateTime", "Hkey"), ("HkeyDateTime", "DateTime", "Hkey"), True),
    "longlat": Merge(("Location", "Longitude", "Latitude"), ("Location", "Longitude", "Latitude")),
}


def new_rows(source: DataFrame, target: DataFrame, keys: tuple[str, ...] | list[str], columns: tuple[str, ...] | list[str], distinct: bool = False) -> DataFrame:
    """Rows of the source whose keys the target lacks, as it was before. Source rows of equal keys are all new together."""
    need(source, *keys, *columns)
    rows = source.select(*columns)
    rows = rows.distinct() if distinct else rows
    return rows.join(target.select(*keys), list(keys), "left_anti").select(*columns)


def merge_into(source: DataFrame, target: DataFrame, table: str) -> DataFrame:
    m = MERGES[table]
    return new_rows(source, target, m.keys, m.columns, m.distinct)


def snapshot(summary: DataFrame, *, zone: str = "Asia/Singapore", at: Column | None = None) -> DataFrame:
    """History rows: when and in which run they were taken, and a hash of their values."""
    now = local_now(zone) if at is None else at
    rows = summary.withColumn("RecordHash", F.xxhash64(*[F.col(c) for c in summary.columns]))
    return rows.withColumn("SnapshotAtSGT", now).withColumn("SnapshotRunId", run_id(F.col("SnapshotAtSGT")))


def unsent(history: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows with a plot that no message was sent for, by Id."""
    rows = history.filter(F.col("AlertTriggered").isNull() & F.col("Plot_Path").isNotNull()).orderBy("Id")
    return rows if limit is None else rows.limit(limit)


def latest_state(log: DataFrame, id_col: str = "Id", order: str = "At") -> DataFrame:
    """The newest row of each id in an append-only log of states."""
    rest = [c for c in log.columns if c != id_col]
    return log.groupBy(id_col).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_x")).select(id_col, "_x.*")


def with_state(history: DataFrame, log: DataFrame) -> DataFrame:
    """History with the newest alert state: a failure leaves AlertTriggered null, so the row is tried again."""
    state = latest_state(log).select("Id", F.when(F.col("Success"), F.lit(1)).alias("AlertTriggered"), F.when(F.col("Success"), F.col("At")).alias("AlertTriggeredAt"), "AlertMessageId", "AlertResponseCode")
    return history.drop("AlertTriggered", "AlertTriggeredAt", "AlertMessageId", "AlertResponseCode").join(state, "Id", "left")


def run_report(history: DataFrame, *, runs: int = 10, quiet_minutes: int = 5, now: Column | None = None) -> DataFrame:
    """The last runs: rows, plots, suppressed rows, and whether a run stayed silent (no plot, and its last write is some minutes old)."""
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    rows = history.groupBy("SnapshotRunId").agg(F.count("*").alias("rows"), F.count("Plot_Path").alias("plots"), F.count_if("Suppressed").alias("suppressed"), F.max("SnapshotAtSGT").alias("last_write"))
    rows = rows.withColumn("silent", (F.col("plots") == 0) & (F.timestamp_diff("MINUTE", F.col("last_write"), now) >= quiet_minutes))
    rows = rows.withColumn("all_suppressed", F.col("suppressed") == F.col("rows"))
    return rows.orderBy(F.desc("last_write"), F.desc("SnapshotRunId")).limit(runs)


def caption() -> Column:
    """The text that goes with a sensor's plot."""
    return F.concat_ws(
        "\n",
        F.format_string("%s | %s", F.coalesce("Equipment", F.lit("?")), F.coalesce("Description", F.lit("?"))),
        F.format_string("Events: %d, anomalous points: %d (%.2f%%)", F.col("Num_Events"), F.col("Anomaly_Points"), F.col("Anomaly_Pct")),
        F.format_string("From %s to %s", F.col("First_Anomaly_Time").cast("string"), F.col("Last_Anomaly_Time").cast("string")),
    )
