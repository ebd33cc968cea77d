"""Functions over a sensor's rows in order of time: rolling statistics, features, distances, thresholds.

All windows of a plan share one partitioning and one order, so they cost one shuffle and one sort. Rolling windows look
at a bounded number of rows, so a long series is cut into blocks of rows that overlap by as many (``in_blocks``), and
its blocks are dealt out; thresholds are exact quantiles by selection, joined back.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from .quantiles import exact_quantiles, largest

#: The published factor; the reference scale multiplies by it, and its thresholds are tuned to that.
SCALE = 1.4826


def in_order(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


#: Rows of a series are numbered by ranges of so many seconds of its first order column, or that much of a number.
RANGE = 3600


def _range(df: DataFrame, column: str) -> Column:
    """A number that grows with the column; columns of other kinds are one range."""
    kind, at = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.TimestampType):
        at = F.floor(F.unix_seconds(at) / RANGE)
    elif isinstance(kind, T.TimestampNTZType):  # local time: a cast to an instant is not in order where clocks change
        at = (F.unix_date(F.to_date(at)) * 86400 + F.hour(at) * 3600 + F.minute(at) * 60) / RANGE
    elif isinstance(kind, T.NumericType):
        at = at / RANGE
    else:
        at = F.lit(0)
    return F.coalesce(F.floor(at), F.lit(-(1 << 62))).cast("long")


def indexed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rn``: the row's place in its series from 0; ``n``: the series' length. Rows with a null key belong to no series.

    A series is numbered in ranges of time: the rows of the ranges before are summed up, and a task only orders the rows
    of a range. ``df`` is read twice.
    """
    known = df.na.drop(subset=list(keys)).withColumn("_range", _range(df, order[0]))
    ranges = known.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select(*keys, "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(W.partitionBy(*keys)).alias("n"))
    own = F.row_number().over(in_order([*keys, "_range"], order)) - 1
    rows = known.withColumn("_own", own).join(ranges, [*keys, "_range"])
    return rows.withColumn("rn", (F.col("_before") + F.col("_own")).cast("int")).drop("_range", "_before", "_own")


BLOCK, HALO = 2048, 64


def in_blocks(df: DataFrame, block: int = BLOCK, halo: int = HALO) -> DataFrame:
    """Rows with their block ``_block``; those within ``halo`` rows of another block are there too, with ``_own`` false.

    Rolling windows over (keys, _block) give own rows what windows over the keys give, while all frames together reach
    no farther than the halo. Needs ``rn``.
    """
    at, place = F.floor(F.col("rn") / block), F.col("rn") % block
    blocks = F.array_compact(F.array(at, F.when((place < halo) & (at > 0), at - 1), F.when(place >= block - halo, at + 1)))
    rows = df.withColumn("_block", F.explode(blocks))
    return rows.withColumn("_own", F.col("_block") == F.floor(F.col("rn") / block))


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_block", "_own")


def joined_back(df: DataFrame, each: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each series beside the series' rows. Spark broadcasts it where it is small, by its size."""
    return df.join(each, list(keys))


def at_least(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Only series of so many rows. Rows with a null key belong to no series."""
    enough = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= rows)
    return df.join(enough, list(keys), "left_semi")


def centred(w: WindowSpec, window: int) -> WindowSpec:
    return w.rowsBetween(-(window // 2), window - 1 - window // 2)


def with_median(df: DataFrame, out: str, value: Column, w: WindowSpec) -> DataFrame:
    """Adds ``percentile(value, 0.5)`` over frames of few rows, whose values are put in order; ``percentile`` builds a map for each row."""
    df = df.withColumn("_values", F.sort_array(F.collect_list(value.cast("double")).over(w)))
    middle = (F.size("_values") - 1) / 2
    low, high = F.get("_values", F.floor(middle).cast("int")), F.get("_values", F.ceil(middle).cast("int"))
    return df.withColumn(out, F.when(low == high, low).otherwise(0.5 * low + 0.5 * high)).drop("_values")


def by_window(df: DataFrame, windows: Sequence[int | Column], most: int, score: Callable[..., DataFrame]) -> DataFrame:
    """``score(rows, *sizes)`` of rows whose windows differ by series: frames are constant in Spark, so the series of each combination in use are scored by themselves.

    ``windows``: numbers of rows, or columns that are the same for all of a series' rows and at most ``most``. Where there are several combinations the
    rows are written by them, so each is read once.
    """
    if all(isinstance(w, int) for w in windows):
        return score(df, *windows)
    names = [f"_window{i}" for i in range(len(windows))]
    sized = df.withColumns({c: F.lit(w).cast("int") if isinstance(w, int) else w.cast("int") for c, w in zip(names, windows, strict=True)})
    used = sorted(tuple(r) for r in sized.select(*names).distinct().collect())
    if any(not 1 <= w <= most for sizes in used for w in sizes):
        raise ValueError(f"windows of 1 to {most} rows are allowed")
    if len(used) < 2:
        return score(df, *(used[0] if used else [most] * len(names)))
    sized = written(sized, "windows", by=names)
    parts = [score(sized.filter(functools.reduce(lambda a, b: a & b, [F.col(c) == k for c, k in zip(names, sizes, strict=True)])).drop(*names), *sizes) for sizes in used]
    return functools.reduce(DataFrame.unionByName, parts)


def robust_z(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, *, window: int | Column = 24, most: int = 24, out: str = "RZ") -> DataFrame:
    """Adds the rolling median, the rolling median deviation (each row from its own centre) and the score.

    ``window``: as for ``by_window``. A deviation of 0 gives a score of 0.
    """
    w, v = in_order(keys, order), F.col(value)

    def score(rows: DataFrame, size: int) -> DataFrame:
        rows = with_median(rows, f"{out}_median", v, centred(w, size))
        rows = rows.withColumn(f"{out}_off", F.abs(v - F.col(f"{out}_median")))
        rows = with_median(rows, f"{out}_mad", F.col(f"{out}_off"), centred(w, size)).drop(f"{out}_off")
        z = F.when(F.col(f"{out}_mad") > 0, SCALE * (v - F.col(f"{out}_median")) / F.col(f"{out}_mad"))
        return rows.withColumn(out, F.coalesce(z, F.lit(0.0)))

    return by_window(df, [window], most, score)


def scored_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, *, z: int = 24, dtw: int = 24) -> DataFrame:
    """``robust_z`` and ``shift_distance`` with the windows that the series' length gives them. Needs ``n``; ``df`` should be a written table."""
    score = lambda rows, a, b: shift_distance(robust_z(rows, keys, order, value, window=a), keys, order, value, window=b)
    return by_window(df, [z_window(F.col("n"), z), dtw_window(F.col("n"), dtw)], max(z, dtw), score)


def z_window(n: Column, most: int = 24) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(5), F.floor(n / 10)))


def dtw_window(n: Column, most: int = 24) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(6), F.floor(n / 12)))


def rolling_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, window: int = 12) -> DataFrame:
    """Difference, trailing mean, trailing sample deviation and slope of the mean; the first row's are 0."""
    w, v = in_order(keys, order), F.col(value)
    back = w.rowsBetween(1 - window, 0)
    df = df.withColumn("f_diff", F.coalesce(v - F.lag(v).over(w), F.lit(0.0))).withColumn("f_mean", F.avg(v).over(back))
    df = df.withColumn("f_std", F.coalesce(F.stddev_samp(v).over(back), F.lit(0.0)))
    return df.withColumn("f_slope", F.coalesce(F.col("f_mean") - F.lag("f_mean").over(w), F.lit(0.0)))


def shift_distance(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, *, window: int | Column = 24, most: int = 24, out: str = "DTW_Dist") -> DataFrame:
    """Warping distance of each window to itself shifted by one row: |last step| + |first step|.

    The two windows share all but their ends and the path between the shared values is free, so the best path only
    pays for its two compulsory corners. Null before a whole window, and for series of less than two windows. Needs ``n``.
    """
    w, v = in_order(keys, order), F.col(value)

    def score(rows: DataFrame, size: int) -> DataFrame:
        rows = rows.withColumn("_step", F.abs(v - F.lag(v).over(w)))
        rows = rows.withColumn("_first", F.lag("_step", size - 1).over(w))
        return rows.withColumn(out, F.when(F.col("n") >= 2 * size, F.col("_step") + F.col("_first"))).drop("_step", "_first")

    return by_window(df, [window], most, score)


def thresholds(df: DataFrame, keys: Sequence[str], *, rate: float = 0.003, z_floor: float = 2.5, z_soft: float = 4.5, dtw_k: float = 6.0) -> DataFrame:
    """(keys, z_thr, d_thr): one row a series. ``df`` is read twice, so it should be a written table or cheap."""
    first = exact_quantiles(df, keys, {"_z": (F.abs("RZ"), 1 - rate), "_d": (F.col("DTW_Dist"), 1 - rate), "_med": (F.col("DTW_Dist"), 0.5)})
    centres = joined_back(df.select(*keys, "DTW_Dist"), first.select(*keys, "_med"), keys)
    both = first.join(exact_quantiles(centres, keys, {"_mad": (F.abs(F.col("DTW_Dist") - F.col("_med")), 0.5)}), list(keys))
    return both.select(*keys, F.greatest(F.lit(z_floor), "_z", F.lit(z_soft)).alias("z_thr"), F.greatest("_d", F.col("_med") + dtw_k * F.col("_mad")).alias("d_thr"))


def calibrated(df: DataFrame, keys: Sequence[str], **options: float) -> DataFrame:
    """Adds each series' thresholds ``z_thr`` and ``d_thr``, and the flags ``Z_Flag`` and ``DTW_Flag`` beyond them."""
    df = joined_back(df, thresholds(df, keys, **options), keys)
    return df.withColumn("Z_Flag", F.abs("RZ") > F.col("z_thr")).withColumn("DTW_Flag", F.coalesce(F.col("DTW_Dist") > F.col("d_thr"), F.lit(False)))


def within_budget(df: DataFrame, keys: Sequence[str], flag: str, *, rate: float = 0.01, out: str | None = None) -> DataFrame:
    """Where a series has more flags than the rate, only those among its ceil(rate * n) rows of largest |RZ| stay.

    Equal scores go in order of ``rn``. Needs ``rn``, ``n`` and ``RZ``.
    """
    out = out or flag
    crowded = df.groupBy(*keys).agg(F.avg(F.col(flag).cast("double")).alias("_share")).filter(F.col("_share") > rate).select(*keys)
    crowded = written(crowded.withColumn("_crowded", F.lit(True)), "crowded")
    if crowded.limit(1).count() == 0:
        return df if out == flag else df.withColumn(out, F.col(flag))
    top = largest(joined_back(df, crowded, keys), keys, F.abs("RZ"), F.ceil(F.lit(rate) * F.col("n")))
    stays = top.filter(F.col(flag)).select(*keys, "rn", F.lit(True).alias("_stays"))
    rows = df.join(crowded, list(keys), "left").join(stays, [*keys, "rn"], "left")
    return rows.withColumn(out, F.col(flag) & (F.col("_crowded").isNull() | F.col("_stays").isNotNull())).drop("_crowded", "_stays")


def contamination(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, *, base: float = 0.01, low: float = 0.001, high: float = 0.05) -> DataFrame:
    """One row a series: ``q1``, ``q3`` and ``cont``, the estimated share of outliers. ``df`` is numbered if it has no ``rn`` and ``n``.

    Rolling medians are only taken of series whose quartiles are equal, as no others use them.
    """
    v = F.col(value)
    rows = df.na.drop(subset=list(keys)) if {"rn", "n"} <= set(df.columns) else indexed(df, keys, order)
    quarters = exact_quantiles(rows, keys, {"q1": (v, 0.25), "q3": (v, 0.75)})
    rows = joined_back(rows.select(*dict.fromkeys([*keys, *order, value, "rn", "n"])), quarters, keys)
    spread = F.col("q3") - F.col("q1")
    flat = in_blocks(written(rows.filter(F.coalesce(spread == 0, F.lit(False))), "flat"))
    flat = own_rows(robust_z(flat, [*keys, "_block"], order, value, window=F.least(F.col("n"), F.lit(24)), most=24, out="_rz"))
    flat = flat.select(*keys, "q1", "q3", (F.abs("_rz") > 3.5).alias("_out"))
    wide = rows.filter(F.coalesce(spread != 0, F.lit(True))).select(*keys, "q1", "q3", ((v < F.col("q1") - 3 * spread) | (v > F.col("q3") + 3 * spread)).alias("_out"))
    share = F.avg(F.col("_out").cast("double")) * 0.7
    each = flat.unionByName(wide).groupBy(*keys).agg(F.first("q1").alias("q1"), F.first("q3").alias("q3"), F.least(F.greatest(share, F.lit(base * 0.5), F.lit(low)), F.lit(high)).alias("cont"))
    return each
