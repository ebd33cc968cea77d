"""Runs of flagged rows: (keys, s, e) with the first and last place of each, inclusive.

A series may have more rows, and more runs, than a task holds: runs are found in parts of ``PART`` rows of a series, each part is summed up (its last end; what it
makes of a cooldown that reaches into it), the sums are carried on from part to part, and the parts are finished with what reaches them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import relative_difference
from ..sources.scratch import written
from .quantiles import exact_quantiles

#: Rows of a series whose runs are looked at by one task.
PART = 1 << 14


def _part(at: str) -> Column:
    return F.floor(F.col(at) / PART).alias("_part")


def runs_of(points: DataFrame, keys: Sequence[str], flag: str | Column, rn: str = "rn") -> DataFrame:
    """In a part, rows whose place less their number among flagged rows is equal stand next to each other; runs that touch across parts are one."""
    flagged = points.filter(F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(False))).select(*keys, F.col(rn).alias("_rn")).withColumn("_part", _part("_rn"))
    island = F.col("_rn") - F.row_number().over(W.partitionBy(*keys, "_part").orderBy("_rn"))
    pieces = flagged.withColumn("_island", island).groupBy(*keys, "_part", "_island").agg(F.min("_rn").cast("int").alias("s"), F.max("_rn").cast("int").alias("e"))
    return merged(pieces.select(*keys, "s", "e"), keys, 0)


def at_least_long(runs: DataFrame, rows: int) -> DataFrame:
    return runs.filter(F.col("e") - F.col("s") + 1 >= rows)


def merged(runs: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Runs with at most ``gap`` rows between them become one."""
    parts, runs = W.partitionBy(*keys).orderBy("_part"), written(runs.withColumn("_part", _part("s")), "runs")
    here = W.partitionBy(*keys, "_part").orderBy("s")
    # The end before a part's first run is that of the last part before it that has any.
    ends = runs.groupBy(*keys, "_part").agg(F.max("e").alias("_end")).select(*keys, "_part", F.lag("_end").over(parts).alias("_before"))
    before = F.coalesce(F.lag("e").over(here), F.col("_before"))
    rows = runs.join(ends, [*keys, "_part"]).withColumn("_apart", F.when(before.isNull() | (F.col("s") - before - 1 > gap), F.col("s")))
    rows = rows.withColumn("_first", F.last("_apart", ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, 0)))
    pieces = written(rows.groupBy(*keys, "_part", "_first").agg(F.min("s").alias("s"), F.max("e").alias("e")), "pieces")
    # A part's first runs may belong to one that began before it.
    starts = pieces.groupBy(*keys, "_part").agg(F.max("_first").alias("_last"))
    starts = starts.select(*keys, "_part", F.last("_last", ignorenulls=True).over(parts.rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    whole = pieces.join(starts, [*keys, "_part"]).withColumn("_first", F.coalesce("_first", "_carried"))
    return whole.groupBy(*keys, "_first").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_first")


def _cool(runs: list[tuple[int, int]], cut: int, rows: int) -> tuple[list[tuple[int, int]], int]:
    """What stays of runs in order where rows up to ``cut`` are clear, and up to where they are clear then."""
    out = []
    for s, e in runs:
        if e > cut:
            out.append((max(s, cut + 1), e))
            cut = e + rows
    return out, cut


def _summed(keys: list[str], rows: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A part's runs as a map: where the first run that is not clear of what reaches in is the i-th, up to where are rows clear after the part.

    What reaches in ends at most ``rows`` rows after a run before the part, so it clears at most as many of its runs.
    """

    def sum_up(part: pd.DataFrame) -> pd.DataFrame:
        runs = sorted(zip(part["s"].tolist(), part["e"].tolist(), strict=True))
        entries = range(min(len(runs), rows + 1))
        return part[[*keys, "_part"]].iloc[:1].assign(ends=[[runs[i][1] for i in entries]], cuts=[[_cool(runs[i:], -1, rows)[1] for i in entries]])

    return sum_up


def _carried(keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Maps of parts in order to the state that reaches each part."""

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, cut = None, -1
        for maps in batches:
            reached = []
            for own, ends, cuts in zip(maps[keys].itertuples(index=False, name=None), maps["ends"], maps["cuts"], strict=True):
                series, cut = own, cut if own == series else -1
                reached.append(cut)
                i = bisect_right(ends, cut)
                cut = int(cuts[i]) if i < len(ends) else cut
            yield maps[[*keys, "_part"]].assign(cut=reached)

    return carry


def _replayed(keys: list[str], rows: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def replay(part: pd.DataFrame) -> pd.DataFrame:
        out, _ = _cool(sorted(zip(part["s"].tolist(), part["e"].tolist(), strict=True)), int(part["cut"].iat[0]), rows)
        stays = pd.DataFrame(out, columns=["s", "e"]).astype({"s": "int32", "e": "int32"})
        return part[keys].iloc[[0] * len(stays)].reset_index(drop=True).assign(s=stays["s"], e=stays["e"])

    return replay


def cooled(runs: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """After each kept run so many rows are clear: a run is cut at its start, or dropped, by the one kept before it.

    Each run depends on the one before, so a part is summed up as a map of what reaches it, the maps are followed in order, and the parts are worked out with it.
    """
    keys = list(keys)
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema if f.name in keys)
    parts = runs.select(*keys, F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")).withColumn("_part", _part("s"))
    parts = written(parts, "runs")
    maps = parts.groupBy(*keys, "_part").applyInPandas(_summed(keys, rows), f"{typed}, _part long, ends array<int>, cuts array<int>")
    ordered = maps.repartition(*keys).sortWithinPartitions(*keys, "_part")
    reached = written(ordered.mapInPandas(_carried(keys), f"{typed}, _part long, cut int"), "reached")
    return parts.join(reached, [*keys, "_part"]).groupBy(*keys, "_part").applyInPandas(_replayed(keys, rows), f"{typed}, s int, e int")


def smoothed(points: DataFrame, keys: Sequence[str], flag: str | Column, *, min_len: int = 6, gap: int = 3, cooldown: int = 12) -> DataFrame:
    return cooled(merged(at_least_long(runs_of(points, keys, flag), min_len), keys, gap), keys, cooldown)


def marked(points: DataFrame, runs: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Whether a row lies in a run. Runs are written out as rows, so this joins on equal keys and not on a range."""
    rows = runs.select(*keys, F.explode(F.sequence("s", "e")).alias("rn")).withColumn(out, F.lit(True))
    return points.join(rows, [*keys, "rn"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def run_values(points: DataFrame, runs: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates over the rows of each run."""
    rows = runs.select(*keys, "s", "e", F.explode(F.sequence("s", "e")).alias("rn"))
    return rows.join(points, [*keys, "rn"]).groupBy(*keys, "s", "e").agg(*aggregates)


def with_steps(points: DataFrame, runs: DataFrame, keys: Sequence[str], value: str, *, window: int = 20, min_window: int = 5, level: float = 0.10) -> DataFrame:
    """Adds ``before`` and ``after``, the medians of up to ``window`` rows on either side of each run, and ``is_step``:
    both sides have ``min_window`` rows and the medians differ by ``level`` of the larger one."""
    sides = runs.select(
        *keys, "s", "e",
        F.explode(F.concat(
            F.transform(F.sequence(F.lit(1), F.lit(window)), lambda k: F.struct((F.col("s") - k).alias("rn"), F.lit("b").alias("side"))),
            F.transform(F.sequence(F.lit(1), F.lit(window)), lambda k: F.struct((F.col("e") + k).alias("rn"), F.lit("a").alias("side"))),
        )).alias("x"),
    ).select(*keys, "s", "e", "x.rn", "x.side")
    # Spark takes the rows of the sides for as few as the runs, and would broadcast them.
    near = sides.hint("merge").join(points.select(*keys, "rn", F.col(value).cast("double").alias("_v")), [*keys, "rn"])
    # ``percentile`` keeps a map of values for each run, and Spark one for each row where runs are many; a side's few rows are put in order instead.
    one = W.partitionBy(*keys, "s", "e", "side")
    near = near.withColumn("_place", F.row_number().over(one.orderBy(F.col("_v").asc_nulls_last())) - 1).withColumn("_middle", (F.count("_v").over(one) - 1) / 2)
    at = lambda side, place: F.max(F.when((F.col("side") == side) & (F.col("_place") == place), F.col("_v")))
    median = lambda side: 0.5 * at(side, F.floor("_middle")) + 0.5 * at(side, F.ceil("_middle"))
    here = lambda side: F.count(F.when(F.col("side") == side, F.lit(1)))
    levels = near.groupBy(*keys, "s", "e").agg(
        median("b").alias("before"), median("a").alias("after"), here("b").alias("n_before"), here("a").alias("n_after")
    )
    rows = runs.join(levels, [*keys, "s", "e"], "left")
    enough = (F.col("n_before") >= min_window) & (F.col("n_after") >= min_window)
    return rows.withColumn("is_step", F.coalesce(enough & (relative_difference(F.col("before"), F.col("after")) >= level), F.lit(False)))


def with_impact(points: DataFrame, runs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds each run's length, largest |RZ|, change from first to last value relative to the series' median |value|, and share of distance flags."""
    scale = exact_quantiles(points, keys, {"_m": (F.abs(value), 0.5)}).withColumn("_m", F.when(F.col("_m") > 1e-9, F.col("_m")).otherwise(F.lit(1.0)))
    each = run_values(
        points, runs, keys,
        [F.count("*").alias("length"), F.max(F.abs("RZ")).alias("peak"), F.min_by(value, "rn").alias("_first"), F.max_by(value, "rn").alias("_last"), F.avg(F.col("DTW_Flag").cast("double")).alias("dtw_rate")],
    )
    return each.join(scale, list(keys)).withColumn("jump", F.abs(F.col("_last") - F.col("_first")) / F.col("_m")).drop("_m", "_first", "_last")
