"""Exact quantiles and largest rows of series that are longer than a task.

Spark's ``percentile`` keeps every distinct value of a group. Here Spark's quantile sketch bounds a quantile from both sides first; the
rows below the bounds are counted where they are, and only values between them are summed up by value and ranked, a
small and known share of the series. The result is the same as ``percentile``'s, interpolation included.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written

#: The sketch is off by at most one row in so many; the bounds are taken ``MARGIN`` of the series away on either side.
ACCURACY = 10_000
MARGIN = 4 / ACCURACY
#: Series of fewer values need no bounds: all of their values are ranked. In longer ones the margin is some rows wide.
SHORT = 50_000
#: Steps of the grid of bounds for a fraction that differs by series.
GRID = 100


def _bounds(value: Column, fraction: float | tuple[Column, float, float]) -> tuple[Column, Column, Column]:
    """The fraction, and aggregates for the lower and the upper bound: null where there is none."""
    sketch = lambda ps: F.percentile_approx(value, [float(p) for p in ps], ACCURACY)
    long, none = F.count(value) > SHORT, F.lit(None).cast("double")
    if not isinstance(fraction, tuple):
        low, high = fraction - MARGIN, fraction + MARGIN
        at = sketch([max(low, 0.0), min(high, 1.0)])
        return F.lit(float(fraction)), F.when(long, at[0]) if low > 0 else none, F.when(long, at[1]) if high < 1 else none
    p, least, most = fraction
    step = (most - least) / GRID
    at = sketch([min(max(least + step * k, 0.0), 1.0) for k in range(GRID + 1)])
    below, above = F.floor((p - MARGIN - least) / step).cast("int"), F.ceil((p + MARGIN - least) / step).cast("int")
    return p, F.when(long, F.get(at, below)), F.when(long & (above <= GRID), F.get(at, F.greatest(above, F.lit(0))))


def exact_quantiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[Column, float | tuple[Column, float, float]]]) -> DataFrame:
    """(keys, one column for each wanted quantile): one row a series, a written table; null where it has no values.

    ``wanted``: name -> (value, fraction). A fraction is a number, or (column, least, most) where it differs by series: the column is the same for all of a series' rows and
    within the two numbers. ``df`` is read twice, so it should be a written table or cheap. Rows with a null key belong to no series.
    """
    names = list(wanted)
    rows = df.na.drop(subset=list(keys))
    for i, (value, fraction) in enumerate(wanted.values()):
        rows = rows.withColumn(f"_v{i}", value.cast("double"))
        if isinstance(fraction, tuple):
            rows = rows.withColumn(f"_f{i}", fraction[0])
    own = [c for c in rows.columns if c in {f"_{x}{i}" for x in "vf" for i in range(len(names))}]
    rows = rows.select(*keys, *own)
    each: list[Column] = []
    for i, (_, fraction) in enumerate(wanted.values()):
        p, low, high = _bounds(F.col(f"_v{i}"), (F.first(f"_f{i}"), *fraction[1:]) if isinstance(fraction, tuple) else fraction)
        n = F.count(f"_v{i}")
        each.append(F.struct(low.alias("low"), high.alias("high"), (p * (n - 1)).alias("place"), n.alias("n")).alias(f"_q{i}"))
    bounds = written(rows.groupBy(*keys).agg(*each), "bounds")
    beside = rows.join(bounds, list(keys))
    # Most rows lie outside the bounds: they are counted as they are read, and only the others become entries.
    below, entries = [], []
    for i in range(len(names)):
        v, q = F.col(f"_v{i}"), F.col(f"_q{i}")
        below.append(F.count_if(v < q["low"]).alias(f"_below{i}"))
        within = F.coalesce(v >= q["low"], v.isNotNull()) & F.coalesce(v <= q["high"], v.isNotNull())
        entries.append(F.when(within, F.struct(F.lit(i).alias("i"), v.alias("x"))))
    some = beside.select(*keys, F.array_compact(F.array(*entries)).alias("_entries")).filter(F.size("_entries") > 0)
    counts = some.select(*keys, F.explode("_entries").alias("e")).groupBy(*keys, "e.i", "e.x").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*keys, "i").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    known = beside.groupBy(*keys).agg(*below).join(bounds, list(keys))
    known = known.select(*keys, F.posexplode(F.array(*[F.struct(F.col(f"_below{i}").alias("below"), F.col(f"_q{i}.place").alias("place"), F.col(f"_q{i}.n").alias("n")) for i in range(len(names))])).alias("i", "q"))
    known = written(known.select(*keys, "i", "q.*"), "places")
    ranked = counts.withColumn("_upto", upto).join(known, [*keys, "i"]).withColumn("_upto", F.col("_upto") + F.col("below"))
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("x")))
    low, high = F.floor("place"), F.ceil("place")
    two = ranked.groupBy(*keys, "i").agg(at(low).alias("a"), at(high).alias("b"), F.max("_upto").alias("upto"))
    two = known.join(two, [*keys, "i"], "left")
    # Series without any value have no entries; others without any have bounds on one side of the quantile.
    missed = (F.col("n") > 0) & F.coalesce((F.col("below") > low) | (F.col("upto") <= high), F.col("upto").isNull())
    value = F.when(missed, F.raise_error(F.lit("a quantile lies outside the bounds of its sketch")).cast("double")).when(low == high, F.col("a")).otherwise((high - F.col("place")) * F.col("a") + (F.col("place") - low) * F.col("b"))
    found = two.select(*keys, "i", value.alias("value")).groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(name) for i, name in enumerate(names)])
    return written(found, "quantiles")


def largest(df: DataFrame, keys: Sequence[str], value: Column, most: Column) -> DataFrame:
    """The rows of ``df`` among the ``most`` largest values of their series; of equal values the ones with the smallest ``rn``.

    ``most`` is the same for all of a series' rows, of which there are ``n``, and at most 5 % of them plus one. Needs ``rn`` and ``n``; ``df`` should be a written table. Null values are the smallest.
    """
    from .windows import indexed

    v = F.coalesce(value.cast("double"), F.lit(float("-inf")))
    rows = df.withColumn("_v", v).withColumn("_most", F.least(most, F.col("n")).cast("long"))
    # The place of the smallest of them, as a fraction of n - 1.
    fraction = F.when(F.col("n") > 1, (F.col("n") - F.col("_most")) / (F.col("n") - 1)).otherwise(F.lit(0.0))
    some = rows.filter(F.col("_most") > 0)
    limit = exact_quantiles(some.withColumn("_p", fraction), keys, {"_low": (F.col("_v"), (F.col("_p"), 0.9, 1.0))})
    # Rounding may put the limit between two values; the rows above the next one down are then the same.
    near = some.join(limit, list(keys)).filter(F.col("_v") <= F.col("_low")).groupBy(*keys).agg(F.max("_v").alias("_limit"))
    some = written(some.join(near, list(keys)), "nearest")
    above = some.filter(F.col("_v") > F.col("_limit"))
    room = some.groupBy(*keys).agg((F.first("_most") - F.count(F.when(F.col("_v") > F.col("_limit"), F.lit(1)))).alias("_room"))
    ties = indexed(some.filter(F.col("_v") == F.col("_limit")).withColumnsRenamed({"rn": "_rn", "n": "_n"}), keys, ["_rn"])
    ties = ties.join(room, list(keys)).filter(F.col("rn") < F.col("_room")).drop("rn", "n", "_room").withColumnsRenamed({"_rn": "rn", "_n": "n"})
    return above.select(*df.columns).unionByName(ties.select(*df.columns))
