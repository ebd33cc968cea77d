"""Numbers of rows in a given order without a window over a table or a series.

Rows are dealt out by ranges of the order and sorted there; each range counts its rows, the counts before it are summed,
and a row's number is that sum and its place in its range. No task sees more than a range, however long a series is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

#: ``monotonically_increasing_id`` keeps the partition above so many bits and the place in it below.
PLACE_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """Adds ``out``, the row's number from 0 in the given order (equal rows in any order; no order: as the rows are dealt out). The rows are written to be numbered.

    Range sampling reads ``df`` twice, so it should be a written table or cheap. Rows that are equal in all of ``order`` stand in one range; name
    columns that tell repeated rows apart where there may be very many.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    placed = placed.withColumn("_at", F.monotonically_increasing_id())
    rows = written(placed, "ranges")
    part = F.shiftrightunsigned("_at", PLACE_BITS)
    ranges = rows.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    # A row for each range: as many as the shuffle has partitions.
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(ranges.select("_range", before.alias("_before")))
    rows = rows.withColumn("_range", part).join(starts, "_range")
    return rows.withColumn(out, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).drop("_at", "_range", "_before")


def numbered_in(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, place: str = "rn", length: str = "n") -> DataFrame:
    """Adds the row's number from 0 in its series and the series' length; rows with a null key belong to no series.

    A series may be longer than a task holds: its first number is an aggregate, and what is joined to its rows is one row a series.
    """
    rows = numbered(df.na.drop(subset=list(keys)), [*keys, *order], "_number")
    series = rows.groupBy(*keys).agg(F.min("_number").alias("_first"), F.count("*").alias(length))
    return rows.join(series, list(keys)).withColumn(place, (F.col("_number") - F.col("_first")).cast("int")).drop("_number", "_first")
