"""The detector as one plan: scores, distances, votes, runs, impact, summary, ranking, suppression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..functions.numbers import out_of_range, profile
from ..operators import runs as R
from ..operators import summary as S
from ..operators import windows as N
from ..operators.isoforest import failed, isolation_flags
from ..operators.suppress import annotate_suppression
from ..schemas import need
from ..sources.scratch import written


def scored(readings: DataFrame, cfg: DetectorConfig, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Readings of long enough series with their scores, flags and votes; ``base`` is the raw verdict of a row."""
    value = "CurrValue"
    rows = N.indexed(readings, keys, order).filter(F.col("n") >= cfg.min_rows)
    # Windows of each length, the forest and its share of outliers all read the numbered rows.
    rows = written(rows.withColumn("Rule_Based_Invalid", out_of_range(F.col("Equipment"), F.col(value))), "numbered")
    # Two rolling medians and a distance reach so many rows to either side.
    parts = N.in_blocks(rows, halo=2 * cfg.z_window + cfg.dtw_window)
    parts = N.scored_windows(parts, [*keys, "_block"], order, value, z=cfg.z_window, dtw=cfg.dtw_window)
    parts = N.own_rows(parts).withColumn("DTW_Dist", F.when(profile(F.col("Equipment"), "dtw"), F.col("DTW_Dist")))
    if cfg.iso_enabled:
        flags = isolation_flags(rows, keys, order, value, trees=cfg.iso_trees, seed=cfg.iso_seed, window=cfg.iso_window, base=cfg.iso_contamination)
        rows = parts.join(flags.select(*keys, "rn", "ISO_Flag", "ISO_Cont", "ISO_Error"), [*keys, "rn"], "left")
    else:
        rows = parts.withColumns({"ISO_Flag": F.lit(False), "ISO_Cont": F.lit(None).cast("double"), "ISO_Error": F.lit(None).cast("string")})
    rows = written(rows, "rolled")  # thresholds and flags both read what the windows gave
    rows = N.calibrated(rows, keys, rate=cfg.target_rate, z_floor=cfg.z_floor, z_soft=cfg.z_soft, dtw_k=cfg.dtw_k)
    rows = rows.withColumn("ISO_Flag", F.coalesce("ISO_Flag", F.lit(False)) & profile(F.col("Equipment"), "iso"))
    rows = N.within_budget(rows, keys, "ISO_Flag", rate=cfg.max_rate)
    rows = rows.withColumn("Z_Flag", F.col("Z_Flag") & profile(F.col("Equipment"), "z")).withColumn("DTW_Flag", F.col("DTW_Flag") & profile(F.col("Equipment"), "dtw"))
    rows = rows.withColumn("ISO_Cont", F.least(F.greatest(F.coalesce("ISO_Cont", F.lit(cfg.iso_contamination)), F.lit(cfg.target_rate / 2)), F.lit(cfg.max_rate)))
    votes = sum(F.col(c).cast("int") for c in ("Z_Flag", "ISO_Flag", "DTW_Flag"))
    return rows.withColumn("base", (votes >= 2) | (F.abs("RZ") > cfg.z_hard))


def kept_runs(points: DataFrame, cfg: DetectorConfig, keys: Sequence[str]) -> DataFrame:
    """The runs that are events: smoothed, without invalid rows, no normal step, and with an impact."""
    value = "CurrValue"
    smooth = R.smoothed(points, keys, "base", min_len=cfg.min_event_len, gap=cfg.merge_gap, cooldown=cfg.cooldown)
    valid = R.marked(points, smooth, keys, "_smooth").withColumn("_valid", F.col("_smooth") & ~F.col("Rule_Based_Invalid"))
    runs = written(R.with_impact(points, R.runs_of(valid, keys, "_valid"), keys, value), "impact")
    if cfg.suppress_steps:
        steps = R.with_steps(points, runs.select(*keys, "s", "e"), keys, value, window=cfg.step_window, min_window=cfg.step_min_window, level=cfg.step_level)
        steps = steps.filter(F.col("is_step"))
        if "Equipment" in keys:
            steps = steps.filter(profile(F.col("Equipment"), "suppress_steps"))
        runs = runs.join(steps.select(*keys, "s", "e"), [*keys, "s", "e"], "left_anti")
    impact = (F.col("peak") >= cfg.event_z) | (F.col("jump") >= cfg.relative_jump) | (F.col("dtw_rate") >= cfg.event_dtw_rate)
    return runs.filter((F.col("length") >= cfg.min_event_len) & impact).select(*keys, "s", "e")


def detect(readings: DataFrame, cfg: DetectorConfig | None = None, *, keys: Sequence[str] = S.KEYS, order: Sequence[str] = ("DateTime", "Id")) -> DataFrame:
    """Every reading of the analysed series with its scores and flags; ``Combined_Anomaly`` marks the events."""
    need(readings, "Equipment", "CurrValue", *keys, *order)
    cfg = cfg or DetectorConfig()
    # Runs, steps and impact all look at the scored rows, which are many windows' work.
    points = written(scored(readings, cfg, keys, order), "points")
    return R.marked(points, kept_runs(points, cfg, keys), keys, "Combined_Anomaly").drop("base")


@dataclass(frozen=True)
class Report:
    """What a run of the detector gives."""

    points: DataFrame
    events: DataFrame
    summary: DataFrame
    top: DataFrame
    #: Series that the forest could not score, and why.
    failed: DataFrame


def report(readings: DataFrame, cfg: DetectorConfig | None = None, *, keys: Sequence[str] = S.KEYS, order: Sequence[str] = ("DateTime", "Id"), output_dir: str | None = None, **suppression) -> Report:
    """Detection, events, summary, and the ranked sensors with their suppression; suppressed ones have no plot."""
    cfg = cfg or DetectorConfig()
    points = written(detect(readings, cfg, keys=keys, order=order), "detected")
    summary = S.sensor_summary(points, output_dir, keys)
    top = annotate_suppression(S.top_sensors(summary, most=cfg.max_sensors, methods=cfg.min_methods, keys=keys), **suppression)
    top = top.withColumn("Plot_Path", F.when(~F.col("Suppressed"), F.col("Plot_Path")))
    return Report(points, S.event_table(points, keys), summary, top, failed(points, keys))
