"""Windows and runs against loops, and the planted series of each rule."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import naive  # noqa: E402

from sensorloom.config import DetectorConfig  # noqa: E402
from sensorloom.operators import runs as R  # noqa: E402
from sensorloom.operators import windows as N  # noqa: E402
from sensorloom.operators.isoforest import forest_scores, isolation_flags  # noqa: E402
from sensorloom.plans.detect import detect, kept_runs  # noqa: E402

KEYS, ORDER = ["k"], ["t"]


def series(spark, **named):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in named.items() for i, v in enumerate(vs)], "k string, t int, v double")


def values(df, column):
    out = {}
    for r in df.orderBy("k", "t").collect():
        out.setdefault(r.k, []).append(r[column])
    return out


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(1)
    return {f"n{n}": rng.normal(10, 2, n).round(2).tolist() for n in (1, 5, 48, 100, 239, 240, 288)}


def test_robust_z(spark, noise):
    rows = N.indexed(series(spark, **noise), KEYS, ORDER)
    fixed = values(N.robust_z(rows, KEYS, ORDER, "v", window=24), "RZ")
    free = values(N.robust_z(rows, KEYS, ORDER, "v", window=N.z_window(F.col("n"))), "RZ")
    for k, v in noise.items():
        assert fixed[k] == pytest.approx(naive.robust_z(v, 24), abs=1e-12)
        assert free[k] == pytest.approx(naive.robust_z(v, min(24, max(5, len(v) // 10))), abs=1e-12)


def test_flat_series_has_no_score(spark):
    got = values(N.robust_z(N.indexed(series(spark, a=[5.0] * 30 + [99.0] + [5.0] * 30), KEYS, ORDER), KEYS, ORDER, "v"), "RZ")["a"]
    assert set(got) == {0.0}


def test_shift_distance_is_exact_warping(spark, noise):
    rows = N.indexed(series(spark, **noise), KEYS, ORDER)
    free = values(N.shift_distance(rows, KEYS, ORDER, "v", window=N.dtw_window(F.col("n"))), "DTW_Dist")
    fixed = values(N.shift_distance(rows, KEYS, ORDER, "v", window=24), "DTW_Dist")
    for k, v in noise.items():
        for w, got in ((min(24, max(6, len(v) // 12)), free[k]), (24, fixed[k])):
            want = [naive.warp(v[i - w : i], v[i - w + 1 : i + 1]) if i >= w and len(v) >= 2 * w else None for i in range(len(v))]
            assert [x is None for x in got] == [x is None for x in want]
            assert [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None])


def test_features(spark):
    v = [1.0, 4.0, 2.0, 8.0]
    got = N.rolling_features(series(spark, a=v), KEYS, ORDER, "v", 3).orderBy("t").collect()
    assert [r.f_diff for r in got] == [0, 3, -2, 6] and [r.f_mean for r in got] == pytest.approx([1, 2.5, 7 / 3, 14 / 3])
    assert [r.f_std for r in got] == pytest.approx([0, np.std([1, 4], ddof=1), np.std([1, 4, 2], ddof=1), np.std([4, 2, 8], ddof=1)]) and got[1].f_slope == 1.5


def test_budget(spark):
    rows = N.indexed(series(spark, a=range(200), b=range(200)), KEYS, ORDER).withColumn("RZ", F.col("v")).withColumn("f", (F.col("k") == "a") | (F.col("v") > 198))
    got = N.within_budget(rows, KEYS, "f").filter("f").groupBy("k").agg(F.sort_array(F.collect_list("t")).alias("t")).collect()
    assert {r.k: r.t for r in got} == {"a": [198, 199], "b": [199]}


def test_contamination(spark):
    flat = [1.0] * 99 + [50.0]
    wide = list(range(98)) + [5000.0, 6000.0]
    got = {r.k: r.cont for r in N.contamination(series(spark, flat=flat, wide=wide, calm=list(range(100))), KEYS, ORDER, "v").collect()}
    assert got["wide"] == pytest.approx(0.014) and got["calm"] == 0.005 and got["flat"] == 0.005


def flags(spark, *patterns):
    rows = [(f"s{j}", i, c == "x") for j, p in enumerate(patterns) for i, c in enumerate(p)]
    return spark.createDataFrame(rows, "k string, rn int, f boolean")


@pytest.mark.parametrize(("min_len", "gap", "cooldown"), [(6, 3, 12), (2, 1, 3), (1, 0, 0), (1, 3, 5)])
def test_smoothing(spark, min_len, gap, cooldown):
    rng = np.random.default_rng(min_len)
    patterns = ["".join(rng.choice(["x", "."], 80, p=[p, 1 - p])) for p in (0.2, 0.5, 0.8, 0.9, 0.95)] * 3 + ["", "." * 5, "x" * 40, "x" * 5 + "." * 3 + "x" * 6, "xxxxxx...xxxxxx....xxxxxx" + "." * 12 + "xxxxxxx"]
    got = {}
    for r in R.smoothed(flags(spark, *patterns), ["k"], "f", min_len=min_len, gap=gap, cooldown=cooldown).collect():
        got.setdefault(r.k, []).append((r.s, r.e))
    for j, p in enumerate(patterns):
        assert sorted(got.get(f"s{j}", [])) == naive.smooth([c == "x" for c in p], min_len, gap, cooldown), p


def test_steps(spark):
    level = [10.0] * 30 + [50.0] * 8 + [12.0] * 30
    same = [10.0] * 30 + [50.0] * 8 + [10.4] * 30
    points = series(spark, level=level, same=same, edge=level[26:], five=level[25:43]).withColumnRenamed("t", "rn")
    runs = spark.createDataFrame([("level", 30, 37), ("same", 30, 37), ("edge", 4, 11), ("five", 5, 12)], "k string, s int, e int")
    got = {r.k: (r.is_step, r.before, r.after) for r in R.with_steps(points, runs, KEYS, "v").collect()}
    assert got["level"] == (True, 10.0, 12.0) and not got["same"][0] and not got["edge"][0] and got["five"][0]


def readings(spark, **named):
    rows = [(kind, f"{kind}-{i}", i, float(v)) for i, (kind, vs) in enumerate(named.items()) for v in vs]
    df = spark.createDataFrame([(a, b, j, v) for j, (a, b, _, v) in enumerate(rows)], "Equipment string, Description string, Id int, CurrValue double")
    return df.withColumn("DateTime", F.expr("timestamp_ntz'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, Id)"))


def bursts(n=400, at=(200, 208), high=60.0, after=0.0, seed=5):
    rng = np.random.default_rng(seed)
    v = rng.normal(10, 0.2, n)
    v[at[0] : at[1]] += high
    v[at[1] :] += after
    return v.tolist()


def test_detector_on_planted_series(spark):
    """A burst that goes back is an event, one that leaves another level is a step, one beyond the valid range is invalid."""
    cfg = DetectorConfig(iso_enabled=False)
    rows = readings(spark, Flowrate=bursts(), Voltage=bursts(after=5.0), Pressure=bursts(), Temperature=bursts(high=40.0), Pump=bursts(n=47, at=(20, 28)))
    got = {r.Equipment: (r.n, r.places) for r in detect(rows, cfg).groupBy("Equipment").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("Combined_Anomaly"), F.col("rn")))).alias("places")).collect()}
    assert "Pump" not in got, "shorter than the least length"
    assert got["Flowrate"][1] == list(range(200, 208))
    assert got["Voltage"][1] == [] and got["Pressure"][1] == []
    assert got["Temperature"][1] == list(range(200, 208)), "by the hard override"
    assert got["Flowrate"][0] == 400
    steps_count = detect(rows, DetectorConfig(iso_enabled=False, suppress_steps=False)).filter("Combined_Anomaly AND Equipment = 'Voltage'").count()
    assert steps_count == 8


def test_impact(spark):
    points = readings(spark, Pump=[10.0] * 60).withColumnRenamed("Id", "rn").withColumns({"RZ": F.lit(0.0), "base": F.col("rn").between(20, 30), "Rule_Based_Invalid": F.col("rn") == 24, "DTW_Flag": F.col("rn").between(26, 27)})
    got = [(r.s, r.e) for r in kept_runs(points, DetectorConfig(min_event_len=6, suppress_steps=False), ["Equipment", "Description"]).collect()]
    assert got == [(25, 30)], "the invalid row splits the run; the part with enough distance flags stays"


def test_blocks_give_what_whole_series_give(spark):
    rng = np.random.default_rng(8)
    rows = N.indexed(series(spark, a=rng.normal(0, 1, 333).round(2).tolist(), b=rng.normal(5, 2, 64).round(2).tolist(), c=[1.0]), KEYS, ORDER)

    def both(df, keys):
        return N.rolling_features(N.shift_distance(N.robust_z(df, keys, ORDER, "v", window=N.z_window(F.col("n"))), keys, ORDER, "v", window=N.dtw_window(F.col("n"))), keys, ORDER, "v")

    whole = both(rows, KEYS)
    parts = N.own_rows(both(N.in_blocks(rows, block=80, halo=72), [*KEYS, "_block"]))
    told = lambda df: sorted((r.k, r.rn, r.RZ, r.DTW_Dist or 0.0, round(r.f_mean, 9), round(r.f_std, 9), round(r.f_slope, 9)) for r in df.collect())
    assert told(whole) == told(parts) and N.in_blocks(rows, block=80, halo=72).filter("_block > 0").select("_block").distinct().count() >= 4


def test_isolation_forest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (500, 2))
    x[:5] += 12
    s = forest_scores(x, 100, 1)
    assert set(np.argsort(-s)[:5]) == set(range(5)) and (s == forest_scores(x, 100, 1)).all() and s.max() <= 1
    v = rng.normal(10, 1, 300)
    v[150:153] = 60
    rows = N.indexed(series(spark, a=v.tolist(), flat=[1.0] * 60), KEYS, ORDER)
    got = isolation_flags(rows, KEYS, ORDER, "v", trees=50).filter("ISO_Flag").collect()
    assert {r.k for r in got} == {"a"} and len(got) <= 5 and {r.rn for r in got} & {150, 151, 152, 153}


def test_levels_of_steps_hold_no_maps(spark):
    """Medians of many runs' sides: no aggregate keeps its values in objects, and nulls and short sides count as before."""
    from sensorloom.operators.runs import with_steps

    points = spark.createDataFrame([("a", i, None if i % 7 == 3 else float(i * i % 23)) for i in range(60)], "k string, rn int, v double")
    runs = spark.createDataFrame([("a", 0, 2), ("a", 3, 3), ("a", 30, 33), ("a", 57, 59)], "k string, s int, e int")
    got = with_steps(points, runs, ["k"], "v", window=6, min_window=5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "rn" in plan and not any("BroadcastHashJoin" in x and "rn#" in x for x in plan.splitlines())
    values = {i: float(i * i % 23) for i in range(60) if i % 7 != 3}

    def median(places):
        some = sorted(values[i] for i in places if i in values)
        return (some[(len(some) - 1) // 2] + some[len(some) // 2]) / 2 if some else None

    for r in got.collect():
        assert (r.before, r.after) == (median(range(r.s - 6, r.s)), median(range(r.e + 1, r.e + 7)))
        assert r.is_step in (True, False) and (5 <= r.s and r.e < 55 or not r.is_step)


def test_rolling_medians_hold_no_maps(spark):
    """The same as ``percentile`` over the frame, nulls, NaN, infinity and short frames included, without its map for each row."""
    values = [None if i % 5 == 2 else (float("inf"), float("nan"), -0.5)[i % 3] if i % 11 == 7 else float(i * i % 23) / 7 for i in range(60)] + [None] * 9
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, rn int, v double")
    w = N.centred(N.in_order(["k"], ["rn"]), 6)
    got = N.robust_z(rows, ["k"], ["rn"], "v", window=6)
    assert "percentile" not in got._jdf.queryExecution().executedPlan().toString()
    both = got.withColumn("want", F.percentile("v", F.lit(0.5)).over(w)).withColumn("off", F.abs(F.col("v") - F.col("want"))).withColumn("want_mad", F.percentile("off", F.lit(0.5)).over(w))
    for r in both.collect():
        assert repr((r.RZ_median, r.RZ_mad)) == repr((r.want, r.want_mad))
