"""Exact quantiles by selection, largest rows, numbers by ranges, and long series in parts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import quantiles as Q
from sensorloom.operators import runs as R
from sensorloom.operators import windows as N
from sensorloom.operators.ranks import numbered, numbered_in
from sensorloom.sources.scratch import temporary, written


def values(spark, **named):
    return spark.createDataFrame([(k, i, None if v is None else float(v)) for k, vs in named.items() for i, v in enumerate(vs)], "k string, rn int, v double")


@pytest.mark.parametrize("short", [0, 50_000])
def test_quantiles_equal_percentile(spark, monkeypatch, short):
    """With and without bounds of a sketch: noise, ties in which a quantile lies, all equal values, nulls, one value, none."""
    monkeypatch.setattr(Q, "SHORT", short)
    rng = np.random.default_rng(4)
    rows = values(
        spark, noise=rng.normal(0, 1, 30_000).tolist(), ties=rng.integers(0, 5, 30_000).tolist(), same=[7.0] * 20_000,
        holes=[None if i % 3 else i for i in range(30_000)], skew=(rng.pareto(1, 30_000) + 1).tolist(), **({"one": [3.0], "none": [None, None], "two": [1.0, 2.0]} if short else {}),
    ).cache()
    share = F.when(F.col("k") == "noise", 0.99).otherwise(0.953)
    wanted = {"low": (F.col("v"), 0.003), "mid": (F.abs("v"), 0.5), "high": (F.col("v"), 0.997), "own": (F.col("v"), (share, 0.95, 0.999))}
    got = {r.k: r for r in Q.exact_quantiles(rows, ["k"], wanted).collect()}
    want = rows.groupBy("k").agg(F.percentile("v", F.lit(0.003)).alias("low"), F.percentile(F.abs("v"), F.lit(0.5)).alias("mid"), F.percentile("v", F.lit(0.997)).alias("high"), F.percentile("v", F.lit(0.99)).alias("p99"), F.percentile("v", F.lit(0.953)).alias("p95")).collect()
    assert len(got) == len(want)
    for r in want:
        assert (got[r.k].low, got[r.k].mid, got[r.k].high) == (r.low, r.mid, r.high), r.k
        assert got[r.k].own == (None if r.p99 is None else pytest.approx(r.p99 if r.k == "noise" else r.p95, abs=1e-12)), r.k


def test_only_a_band_is_ranked(spark):
    """What reaches the ranking of a long series is a small share of its values."""
    rows = spark.range(400_000).select(F.lit("a").alias("k"), F.rand(3).alias("v"))
    got = Q.exact_quantiles(rows, ["k"], {"q": (F.col("v"), 0.997)}).first()
    assert got.q == rows.agg(F.percentile("v", F.lit(0.997))).first()[0]
    low, high = rows.agg(*[F.percentile_approx("v", p, Q.ACCURACY) for p in (0.997 - Q.MARGIN, 0.997 + Q.MARGIN)]).first()
    assert rows.filter(F.col("v").between(low, high)).count() < 400_000 * 3 * Q.MARGIN


def test_largest_rows(spark):
    rng = np.random.default_rng(2)
    named = {"noise": rng.normal(0, 1, 500).tolist(), "ties": rng.integers(0, 3, 500).tolist(), "zero": [0.0] * 300, "few": [1.0, 5.0, 2.0], "one": [1.0]}
    rows = written(N.indexed(values(spark, **named).withColumnRenamed("rn", "t"), ["k"], ["t"]), "rows")
    got = {}
    for r in Q.largest(rows, ["k"], F.col("v"), F.ceil(F.lit(0.03) * F.col("n"))).collect():
        got.setdefault(r.k, set()).add(r.rn)
    for k, v in named.items():
        order = sorted(range(len(v)), key=lambda i: (-v[i], i))
        assert got[k] == set(order[: int(np.ceil(0.03 * len(v)))]), k


def test_numbers_by_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][int(rng.integers(3))], int(t), i) for i, t in enumerate(rng.integers(0, 20_000, 900))] + [("c", None, 1000), ("c", 5, 1001)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    want = {}
    for k in "abc":
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: (at, len(own)) for at, r in enumerate(own)}
    for got in (N.indexed(df, ["k"], ["t", "i"]), numbered_in(df, ["k"], ["t", "i"])):
        assert {r.i: (r.rn, r.n) for r in got.collect()} == want
    for kind in ("timestamp", "timestamp_ntz"):
        timed = df.withColumn("t", F.expr(f"cast('2025-03-30 00:00:00' as {kind}) + make_interval(0, 0, 0, 0, 0, 0, t)"))
        assert {r.i: (r.rn, r.n) for r in N.indexed(timed, ["k"], ["t", "i"]).collect()} == want
    assert [r.n for r in numbered(spark.range(50).repartition(7), [F.col("id").desc()], "n").orderBy("id").collect()] == list(range(49, -1, -1))
    assert numbered(spark.range(0), ["id"], "n").count() == 0


@pytest.mark.parametrize("part", [4, 16])
def test_runs_in_parts(spark, monkeypatch, part):
    """Runs, gaps and cooldowns that reach over the borders of parts."""
    import naive

    monkeypatch.setattr(R, "PART", part)
    rng = np.random.default_rng(part)
    patterns = ["".join(rng.choice(["x", "."], 120, p=[p, 1 - p])) for p in (0.3, 0.6, 0.9)] + ["x" * 50 + "." * 3 + "x" * 40, "x..x" * 25, "." * 9]
    rows = spark.createDataFrame([(f"s{j}", i, c == "x") for j, p in enumerate(patterns) for i, c in enumerate(p)], "k string, rn int, f boolean")
    for min_len, gap, cooldown in ((1, 0, 0), (1, 2, 3), (2, 1, 9)):
        got = {}
        for r in R.smoothed(rows, ["k"], "f", min_len=min_len, gap=gap, cooldown=cooldown).collect():
            got.setdefault(r.k, []).append((r.s, r.e))
        for j, p in enumerate(patterns):
            assert sorted(got.get(f"s{j}", [])) == naive.smooth([c == "x" for c in p], min_len, gap, cooldown), p


def test_written_tables_have_an_owner(spark):
    with temporary(spark):
        with temporary(spark):
            inner, outer = written(spark.range(3), "inner"), written(spark.range(4), "outer", keep=True)
            assert inner.count() == 3
        with pytest.raises(Exception, match="PATH|path|FileNotFound|does not exist"):
            spark.read.parquet(inner.inputFiles()[0]).count()
        assert outer.count() == 4
    by = written(spark.range(10).withColumn("p", F.col("id") % 3), "by", by=["p"])
    assert by.columns == ["id", "p"] and by.filter("p = 1").count() == 3


def test_median_of_a_summary_holds_no_map(spark):
    """A sensor's median comes by selection; no aggregate keeps a series' values in one task."""
    from sensorloom.operators.summary import sensor_summary

    rows = spark.createDataFrame([("e", k, i, None if i % 4 == 1 else float(i * i % 17), k == "a" and i == 3) for k in "ab" for i in range(40)], "Equipment string, Description string, rn int, CurrValue double, Combined_Anomaly boolean")
    flags = {c: F.lit(False) for c in ("Z_Flag", "ISO_Flag", "DTW_Flag")} | {"RZ": F.lit(1.0), "DTW_Dist": F.lit(None).cast("double"), "DateTime": F.timestamp_seconds("rn")}
    got = sensor_summary(rows.withColumns(flags))
    assert "percentile(" not in got._jdf.queryExecution().executedPlan().toString()
    values = sorted(float(i * i % 17) for i in range(40) if i % 4 != 1)
    assert [(r.Description, r.Median_Value) for r in got.collect()] == [("a", (values[14] + values[15]) / 2)]


def test_bounds_that_miss_raise(spark, monkeypatch):
    """Bounds between which no value lies are an error, not a null."""
    monkeypatch.setattr(Q, "SHORT", 0)
    monkeypatch.setattr(Q, "MARGIN", -0.01)
    rows = spark.range(30_000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    with pytest.raises(Exception, match="outside the bounds"):
        Q.exact_quantiles(rows, ["k"], {"q": (F.col("v"), 0.5)})
