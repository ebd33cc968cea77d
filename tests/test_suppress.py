"""Suppression and prefix groups against all pairs, and a block that is too dense for pairs."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sensorloom.functions.text import ratio
from sensorloom.operators import suppress as P
from sensorloom.operators.suppress import annotate_suppression, first_within, near_time_pairs, prefix_groups, prefix_pairs
from sensorloom.queries import prefix_cluster

START = "timestamp_ntz'2025-01-01 00:00:00'"


def shifted(column: str):
    return F.expr(f"{START} + make_interval(0, 0, 0, 0, 0, 0, {column})")


def test_first_within():
    rng = np.random.default_rng(1)
    reach = 300
    for _ in range(60):
        n, m = rng.integers(1, 30, 2)
        points = pd.DataFrame({"start": rng.integers(300, 600, n), "end": rng.integers(300, 600, n), "id": rng.integers(0, 40, n)})
        ds, de = rng.integers(-1, 2, m), rng.integers(-1, 2, m)
        start, end = rng.integers(300, 600, m) - ds * reach, rng.integers(300, 600, m) - de * reach
        asked = pd.DataFrame({"id": rng.integers(0, 40, m), "ds": ds, "de": de, "x": start + ds * reach, "y": end + de * reach})
        got, ids = first_within(points, asked), np.unique(points["id"])
        for i in range(m):
            near = [p.id for p in points.itertuples() if p.id != asked["id"][i] and abs(p.start - start[i]) <= reach and abs(p.end - end[i]) <= reach]
            assert (ids[got[i]] if got[i] >= 0 else None) == min(near, default=None)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    names = ["Pump house north A", "Pump house north B", "Pump house", "Pump hause", "Mixer", "Mixers", "", None, "Level gauge of quay 1", "Level gauge of quay 2", "level"]
    rows = [(int(i), names[rng.integers(len(names))], int(rng.integers(0, 2400)), int(rng.integers(0, 2400))) for i in rng.permutation(220)]
    df = spark.createDataFrame(rows, "id long, name string, a int, b int").withColumns({"a": shifted("a"), "b": shifted("b")})

    def alike(x, y):
        return bool(x) and bool(y) and (x == y or (min(len(x), len(y)) >= 15 and os.path.commonprefix([x, y])[:15] == x[:15]) or ratio(x, y) >= 0.85)

    want = {}
    for i, name, a, b in rows:
        peers = [(c // 300, d // 300, j) for j, other, c, d in rows if i != j and abs(a - c) <= 300 and abs(b - d) <= 300 and alike(name, other)]
        want[i] = f"clustered_with: {min(peers)[2]}" if peers else None
    got = annotate_suppression(df, start_col="a", end_col="b", description_col="name", id_col="id").collect()
    assert {r.id: r.Suppression_Reason for r in got} == want and all(r.Suppressed == (r.Suppression_Reason is not None) for r in got)
    assert 20 < sum(v is not None for v in want.values()) < 220


def test_a_dense_block(spark):
    """100,000 rows of one name in one block: 10^10 pairs, of which none is made."""
    rows = spark.range(100_000).select("id", F.lit("one name for all of them").alias("name"), shifted("id % 290").alias("a"), shifted("(id * 7) % 290").alias("b"))
    got = annotate_suppression(rows, start_col="a", end_col="b", description_col="name", id_col="id").groupBy("Suppression_Reason").count().collect()
    assert {(r[0], r[1]) for r in got} == {("clustered_with: 0", 99_999), ("clustered_with: 1", 1)}


def test_prefix_groups(spark):
    rows = [(1, "a", "pump north"), (2, "a", "pump nose"), (3, "b", "pump north"), (4, "a", "pum"), (5, "a", None), (6, "a", "pump n"), (7, "b", "valve"), (8, "a", "pumpe")]
    df = spark.createDataFrame(rows, "i int, site string, label string")
    got = {r.id: (r.group, r.members, r.links, r.shared) for r in prefix_groups(df, id_col="i", name_col="label", length=5, within_cols=["site"]).collect()}
    assert got == {1: (1, 3, 2, 6), 2: (1, 3, 2, 6), 6: (1, 3, 2, 6)}
    assert {r.id for r in prefix_groups(df, id_col="i", name_col="label", length=5).collect()} == {1, 2, 3, 6}
    hot = spark.range(200_000).select("id", F.concat(F.lit("same beginning "), "id").alias("label"))
    assert prefix_groups(hot, id_col="id", name_col="label", length=15).filter("group = 0 AND links = 199999 AND shared = 15").count() == 200_000


def test_prefix_cluster_lists_all_pairs(spark, monkeypatch, tmp_path):
    """Each two parts of a brand and a beginning are a row, also where they are dealt to many packs."""
    monkeypatch.setattr(P, "PACK", 8)
    rows = [(i, f"pump {i % 7}" if i % 10 else "pum", f"Brand#{i % 3}") for i in range(150)] + [(200, None, "Brand#1"), (201, "pump x", None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = prefix_cluster(spark, str(tmp_path))
    want = {(a, b) for a, x, p in rows for b, y, q in rows if a < b and p and p == q and x and y and min(len(x), len(y)) >= 5 and x[:5] == y[:5]}
    pairs = [tuple(r) for r in got.collect()]
    assert got.columns == ["id", "peer"] and len(want) > 2000 and len(pairs) == len(want) and set(pairs) == want


def test_prefix_pairs_come_in_runs(spark, monkeypatch):
    """A row of the plan gives few pairs, and a task gives an id's pairs in runs, in order; ids may be texts and repeat."""
    monkeypatch.setattr(P, "PACK", 16)
    monkeypatch.setattr(P, "SLICE", 4, raising=False)
    held, plain = [], P.met
    monkeypatch.setattr(P, "met", lambda *a: (lambda x: held.append(x.agg(F.max(F.size("_own"))).first()[0]) or x)(plain(*a)))
    ids = [f"{i * 7919 % 10007:05d}" for i in range(300)] + ["00000", "00000", "07919"]
    rows = spark.createDataFrame([(i, f"same beginning {i}") for i in ids], "i string, label string")
    got = prefix_pairs(rows, id_col="i", name_col="label", length=5).select("id", "peer", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.id, r.peer) for r in got) == sorted((a, b) for a in ids for b in ids if a < b)
    assert held == [4]
    runs = sum(y.task != x.task or y.id != x.id or y.peer < x.peer for x, y in zip(got, got[1:]))
    # 303 rows in 19 packs: a row's pairs are in as many runs as there are packs from its own on, 10 by the mean.
    assert runs <= 303 * 10


def test_pairs_of_a_dense_block_are_dealt_out(spark, monkeypatch):
    """A block's pairs are no one task's, and are the same as by all pairs."""
    monkeypatch.setattr(P, "PACK", 32, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(400).select("id", shifted("300 + id % 7").alias("a"), shifted("id * 9").alias("b"))
        got = near_time_pairs(rows, id_col="id", start_col="a", end_col="b", minutes=60).select("id", "peer", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 400 * 399 and len({(r.id, r.peer) for r in got}) == 400 * 399
    assert len({r.task for r in got}) > 2


def test_copies_in_time_are_asked_for_once(spark, monkeypatch):
    """Rows of one name and the same times: two of them are asked for and answer, all get their peer."""
    monkeypatch.setattr(P, "FEW", 4)
    asked, plain = [], P.written
    monkeypatch.setattr(P, "written", lambda df, name: (lambda x: asked.append(x.count()) or x if name == "asked" else x)(plain(df, name)))
    rows = spark.range(900).select("id", F.concat(F.lit("pump number "), (F.col("id") % 3).cast("string")).alias("name"), shifted("id % 9 * 200").alias("a"), shifted("id % 9 * 200 + 50").alias("b"))
    got = {r.id: r.Suppression_Reason for r in annotate_suppression(rows, start_col="a", end_col="b", description_col="name", id_col="id", similarity_threshold=2.0, tolerance_min=5).collect()}
    # (blocks of start and end, id) of those of the same prefix ("pump number 0" has fewer than 15 characters, so of the same name) within 300 seconds.
    want = {}
    for i in range(900):
        near = [((t := j % 9 * 200) // 300, (t + 50) // 300, j) for j in range(900) if j != i and j % 3 == i % 3 and abs(j % 9 - i % 9) * 200 <= 300]
        want[i] = f"clustered_with: {min(near)[2]}"
    assert got == want
    assert asked == [2 * 9 * 9]
