"""From the exports to the detector's readings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import star as J
from ..operators.merge import snapshot
from ..sources.database import Store


@dataclass(frozen=True)
class Star:
    dim: DataFrame
    inst: DataFrame
    alarmevent: DataFrame
    linktable: DataFrame
    date_dim: DataFrame
    bad_alarms: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"dim": self.dim, "inst": self.inst, "alarmevent": self.alarmevent, "linktable": self.linktable, "dateDim": self.date_dim}


def star(histcurr: DataFrame, history: DataFrame, histalmevt: DataFrame) -> Star:
    dim, inst = C.dimension(histcurr), C.instances(history)
    alarm, bad = C.alarms(histalmevt)
    links = C.link_table(alarm, inst)
    return Star(dim, inst.select("HkeyDateTime", "CurrValue"), alarm.select("HkeyDateTime", "Status"), links, C.date_dimension(links), bad)


def detector_input(tables: Star, longlat: DataFrame, *, excluded: tuple[str, ...] = (), hours: int | None = 72, watch: Observation | None = None) -> DataFrame:
    """Located readings of the last hours, without the excluded classes of equipment.

    ``watch`` gets the numbers of readings (rows), of those without a class, a time or a value, and of those of excluded classes, from the pass that reads them.
    """
    rows = J.readings(tables.inst, tables.linktable, J.located(tables.dim, longlat))
    if watch is not None:
        missing = {f"without_{c}": F.count_if(F.col(c).isNull()) for c in ("Equipment", "DateTime", "CurrValue")}
        counts = {"rows": F.count(F.lit(1)), "excluded": F.count_if(F.coalesce(F.col("Equipment").isin(*excluded), F.lit(False))) if excluded else F.count_if(F.lit(False))} | missing
        rows = rows.observe(watch, *[x.alias(name) for name, x in counts.items()])
    rows = C.without_kinds(rows, "Equipment", excluded) if excluded else rows
    return C.since_newest(rows, "DateTime", hours=hours, inclusive=True) if hours else rows


def persist(store: Store, tables: Star, readings: DataFrame, top: DataFrame, *, zone: str = "Asia/Singapore", skip: bool = False) -> dict[str, str]:
    """Merges the tables and appends the ranked sensors to the history."""
    spark = readings.sparkSession
    done = store.merge_all(spark, tables.tables() | {"data": readings}, skip)
    if not skip:
        store.append(snapshot(top, zone=zone), "abnormal_sensor_history")
    return done
