"""One run: from folders of hourly exports to ranked sensors, merged tables and history."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Observation, SparkSession

from ..config import DetectorConfig
from ..schemas import HISTALMEVT, HISTCURR, HISTORY, LONGLAT
from ..sources.database import Store
from ..sources.files import gated_window, newest_by_name, read_decoded
from ..sources.scratch import written
from .detect import Report, report
from .ingest import detector_input, persist, star


@dataclass(frozen=True)
class Feeds:
    """File names of the feeds: the list of sensors and the places are the newest file, the others one an hour."""

    sensors: str = r"HISTCURR.*\.csv"
    readings: str = r"hts_\d{4}_\d{2}_HISTORY_"
    alarms: str = r"hts_\d{4}_\d{2}_HISTALMEVT_"
    places: str = r"LongLat.*\.csv"


@dataclass(frozen=True)
class Outcome:
    coverage: Mapping
    report: Report
    merged: Mapping[str, str]
    #: Readings, and those without a class, time or value or of an excluded class, counted as they were read.
    seen: Mapping[str, int]


def run(spark: SparkSession, root: str, store: Store, now: datetime, *, feeds: Feeds | None = None, cfg: DetectorConfig | None = None, excluded: tuple[str, ...] = (), skip_merge: bool = False, window_hours: int = 72, grace_minutes: int = 30, max_missing_percent: float = 25.0) -> Outcome:
    """Raises before any work if too few hours are there. Rows that do not fit their schema are left out."""
    feeds, gate = feeds or Feeds(), {"window_hours": window_hours, "grace_minutes": grace_minutes, "max_missing_percent": max_missing_percent}
    readings, alarms = gated_window(spark, root, feeds.readings, now, **gate), gated_window(spark, root, feeds.alarms, now, **gate)
    sensors = read_decoded(spark, newest_by_name(spark, root, feeds.sensors), HISTCURR)
    history = read_decoded(spark, readings.paths, HISTORY, sep=";", skip_malformed=True)
    events = read_decoded(spark, alarms.paths, HISTALMEVT, sep=";", skip_malformed=True)
    tables = star(sensors, history, events)
    watch = Observation()
    rows = detector_input(tables, read_decoded(spark, newest_by_name(spark, root, feeds.places), LONGLAT), excluded=excluded, hours=window_hours, watch=watch)
    rows = written(rows, "readings")
    seen = dict(watch.get)
    found = report(rows, cfg, order=("DateTime", "HkeyDateTime"))
    return Outcome(readings.info, found, persist(store, tables, rows, found.top, skip=skip_merge), seen)
