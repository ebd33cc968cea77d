"""Suppression of sensors that report the same trouble: alike in time and in name.

Start and end times are put into blocks as long as the tolerance; times within it are in the same block or in
neighbours. Of a row only the first peer is asked for, so rows are not paired: the rows of a pair of blocks that share a name, or the
beginning of one, answer each row of the same or a neighbouring pair of blocks with their smallest id within the tolerance. Names that are only
similar are compared once for each two names that stand in neighbouring blocks, not for each two rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import common_prefix_length, same_prefix, similarity
from ..functions.times import block_number
from ..schemas import need
from ..sources.scratch import written
from .ranks import numbered_in

#: Points of one pair of blocks and one name that each row may meet.
FEW = 32


def _microseconds(t: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)


#: Rows of a cell that are packed into one array.
PACK = 512

#: Rows of a pack that meet another pack at a time. Spark holds all pairs that come of one row until it passes them on.
SLICE = 32


def packed(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, _part, _pack), a written table: the rows of each cell, dealt to arrays of about ``PACK``. A cell may have more rows than a task holds."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / PACK).alias("_parts"))
    dealt = rows.join(sizes, list(by)).withColumn("_part", F.pmod(F.xxhash64(*columns), F.col("_parts")))
    return written(dealt.groupBy(*by, "_part").agg(F.collect_list(F.struct(*columns)).alias("_pack")), "packs")


def met(asking: DataFrame, packs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each row of ``asking`` beside each pack ``_pack`` of its cell. Packs of one cell are dealt out, so no task gets a whole cell's pairs."""
    parts = packs.groupBy(*by).agg(F.collect_list("_part").alias("_all"))
    dealt = asking.join(parts, list(by)).withColumn("_part", F.explode("_all")).drop("_all")
    # Packs are few bytes and much work, so the number of tasks does not go by their size.
    tasks = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, *by, "_part").join(packs, [*by, "_part"])


def near_time_pairs(df: DataFrame, *, id_col: str, start_col: str, end_col: str, minutes: int) -> DataFrame:
    """(id, peer, sb, eb) of rows whose starts and whose ends are at most so many minutes apart, excluding themselves; sb and eb are the peer's blocks.

    All pairs are asked for, so the work is their number. What is shuffled is packs of rows; pairs come up where two packs meet, and are compared as numbers.
    """
    shifts, by = F.array(F.lit(-1), F.lit(0), F.lit(1)), ["sb", "eb"]
    sb, eb = block_number(F.col(start_col), minutes), block_number(F.col(end_col), minutes)
    here = df.select(F.col(id_col).alias("id"), _microseconds(F.col(start_col)).alias("start"), _microseconds(F.col(end_col)).alias("end"), sb.alias("sb"), eb.alias("eb"))
    packs = packed(here.na.drop(subset=["id", *by]), by, ["id", "start", "end"])
    # Two rows that are near may be in neighbouring blocks.
    asking = packs.withColumn("ds", F.explode(shifts)).withColumn("de", F.explode(shifts)).select((F.col("sb") + F.col("ds")).alias("sb"), (F.col("eb") + F.col("de")).alias("eb"), F.col("_pack").alias("_own"))
    pairs = met(asking, packs, by).select(*by, "_pack", F.inline("_own")).select(*by, "id", "start", "end", F.inline("_pack").alias("peer", "pstart", "pend"))
    reach = minutes * 60 * 1_000_000
    near = (F.abs(F.col("start") - F.col("pstart")) <= reach) & (F.abs(F.col("end") - F.col("pend")) <= reach)
    return pairs.filter((F.col("id") != F.col("peer")) & near).select("id", "peer", *by)


def prefix_pairs(df: DataFrame, *, id_col: str, name_col: str, length: int, within_cols: Sequence[str] = ()) -> DataFrame:
    """(id, peer), id < peer, of all rows of the same ``within`` whose names begin with the same ``length`` characters. Shorter names and null ones have no peers."""
    need(df, id_col, name_col, *within_cols)
    by = [*within_cols, "_prefix"]
    rows = df.filter(F.length(name_col) >= length).select(*within_cols, F.left(F.col(name_col), F.lit(length)).alias("_prefix"), F.col(id_col).alias("id"))
    # A pack is a range of its cell's ids, so each two packs meet once, the one of the smaller ids first, and pairs come out in runs of an id.
    placed = numbered_in(rows.na.drop(subset=["id", *by]), by, ["id"], place="_place", length="_n").withColumn("_part", F.floor(F.col("_place") / PACK))
    packs = written(placed.groupBy(*by, "_part").agg(F.sort_array(F.collect_list("id")).alias("_pack")), "packs")
    slices = F.transform(F.sequence(F.lit(1), F.size("_pack"), F.lit(SLICE)), lambda i: F.slice("_pack", i, SLICE))
    each = met(packs.select(*by, F.col("_part").alias("_mine"), F.explode(slices).alias("_own")), packs, by).filter("_mine <= _part")
    return each.select("_pack", F.explode("_own").alias("id")).select("id", F.explode("_pack").alias("peer")).filter("id < peer")


class SmallestTwo:
    """The two smallest different numbers of those put at a place or before it (a Fenwick tree)."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, places: int):
        self.first, self.second = [self.NONE] * (places + 1), [self.NONE] * (places + 1)

    def put(self, place: int, number: int) -> None:
        i = place + 1
        while i < len(self.first):
            if number < self.first[i]:
                self.first[i], self.second[i] = number, self.first[i]
            elif self.first[i] < number < self.second[i]:
                self.second[i] = number
            i += i & -i

    def other(self, places: int, own: int) -> int:
        """The smallest of the first ``places`` places that is not ``own``."""
        best, i = self.NONE, places
        while i:
            found = self.first[i] if self.first[i] != own else self.second[i]
            best = min(best, found)
            i -= i & -i
        return best


def first_within(points: pd.DataFrame, asked: pd.DataFrame) -> np.ndarray:
    """For each asked row the smallest id of points (start, end, id) other than its own with start and end within its bounds, as a place among the sorted ids; -1 where there is none.

    A row's block is the points' or a neighbour of it, so each time is bounded on one side at most: ``ds`` and ``de`` say on which, ``x`` and ``y`` where.
    """
    ids = np.sort(np.unique(points["id"].to_numpy()))
    number = np.searchsorted(ids, points["id"].to_numpy())
    own = np.searchsorted(ids, asked["id"].to_numpy())
    own = np.where((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == asked["id"].to_numpy()), own, -1)
    out = np.full(len(asked), -1, np.int64)
    for (ds, de), part in asked.reset_index(drop=True).groupby(["ds", "de"]):
        px, py = ds * points["start"].to_numpy(), de * points["end"].to_numpy()
        heights = np.unique(py)
        place, order = np.searchsorted(heights, py), np.argsort(px, kind="stable").tolist()
        upto = np.searchsorted(heights, de * part["y"].to_numpy(), side="right")
        tree, k = SmallestTwo(len(heights)), 0
        bound = ds * part["x"].to_numpy()
        for i in np.argsort(bound, kind="stable").tolist():
            while k < len(order) and px[order[k]] <= bound[i]:
                tree.put(int(place[order[k]]), int(number[order[k]]))
                k += 1
            found = tree.other(int(upto[i]), int(own[part.index[i]]))
            out[part.index[i]] = -1 if found == tree.NONE else found
    return out


def _answer(points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    if not len(points) or not len(asked):
        return asked[["id", "sb", "eb"]].iloc[:0].assign(peer=asked["id"].iloc[:0])
    ids, place = np.sort(np.unique(points["id"].to_numpy())), first_within(points, asked)
    found = place >= 0
    return asked[["id", "sb", "eb"]][found].assign(peer=ids[place[found]])


def first_peers(rows: DataFrame, alike: DataFrame, *, prefix: int, minutes: int) -> DataFrame:
    """(id, peer) of rows (id, name, start, end): the first peer by block and id that is near in time and alike in name.

    ``alike``: (name, other) of different names that count as alike beyond equal ones and equal beginnings of ``prefix`` characters.
    Of rows with equal name and times only the two smallest ids can be first peers, and the others have the second one's: the smallest is near them all.
    """
    by = ["name", "start", "end"]
    rows = written(rows.na.drop(subset=["id", *by]), "spans")
    leads = written(rows.withColumn("_rank", F.dense_rank().over(W.partitionBy(*by).orderBy("id"))).filter("_rank <= 2"), "leads")
    points = leads.select("id", *by).distinct()
    # That holds where an id is one row; a row is asked for by itself where ids repeat.
    if rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        return _first_peers(points, rows, alike, prefix=prefix, minutes=minutes)
    first = written(_first_peers(points, points, alike, prefix=prefix, minutes=minutes), "first")
    second = leads.filter("_rank = 2").join(first, "id").select(*by, "peer")
    others = rows.join(leads.select("id"), "id", "left_anti").join(second, by).select("id", "peer")
    return first.unionByName(others)


def _first_peers(peers: DataFrame, rows: DataFrame, alike: DataFrame, *, prefix: int, minutes: int) -> DataFrame:
    """(id, peer) of ``rows``: the first of ``peers``. Both (id, name, start, end)."""
    shifts = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    shared = F.when(F.length("name") >= prefix, F.concat(F.lit("p:"), F.left("name", F.lit(prefix)))).otherwise(F.concat(F.lit("n:"), F.col("name")))
    whole = F.concat(F.lit("n:"), F.col("name"))
    placed = lambda x: x.withColumns({"sb": block_number(F.col("start"), minutes), "eb": block_number(F.col("end"), minutes), "start": _microseconds(F.col("start")), "end": _microseconds(F.col("end"))})
    here = placed(rows)
    points = placed(peers).select("sb", "eb", F.explode(F.array_distinct(F.array(shared, whole))).alias("key"), "id", "start", "end")
    asked = here.select("id", "name", "sb", "eb", "start", "end", shared.alias("key")).unionByName(here.join(alike, "name").select("id", "name", "sb", "eb", "start", "end", F.concat(F.lit("n:"), F.col("other")).alias("key")))
    asked = asked.withColumn("ds", F.explode(shifts)).withColumn("de", F.explode(shifts))
    reach = minutes * 60 * 1_000_000
    # A peer in a later block starts at most the tolerance after, one in an earlier block at most the tolerance before.
    asked = asked.select("key", "id", (F.col("sb") + F.col("ds")).alias("sb"), (F.col("eb") + F.col("de")).alias("eb"), "ds", "de", (F.col("start") + F.col("ds") * reach).alias("x"), (F.col("end") + F.col("de") * reach).alias("y"))
    by = ["sb", "eb", "key"]
    asked, points = written(asked, "asked"), written(points, "points")
    sizes = points.groupBy(*by).agg(F.count("*").alias("n"))
    # Where few points share blocks and a name, a row meets each of them; elsewhere they are ordered, and it meets none.
    few = points.join(sizes.filter(F.col("n") <= FEW), by, "left_semi").withColumnsRenamed({"id": "peer"})
    ds, de = F.col("ds"), F.col("de")
    near = (F.col("id") != F.col("peer")) & (ds * F.col("start") <= ds * F.col("x")) & (de * F.col("end") <= de * F.col("y"))
    met = asked.join(few, by).filter(near).select("id", "sb", "eb", "peer")
    dense = written(sizes.filter(F.col("n") > FEW).select(*by), "dense")
    if dense.limit(1).count():
        kind = dict(rows.dtypes)["id"]
        many, of = points.join(dense, by, "left_semi"), asked.join(dense, by, "left_semi")
        met = met.unionByName(many.groupBy(*by).cogroup(of.groupBy(*by)).applyInPandas(_answer, f"id {kind}, sb long, eb long, peer {kind}"))
    return met.groupBy("id").agg(F.min_by("peer", F.struct("sb", "eb", "peer")).alias("peer"))


def alike_names(rows: DataFrame, *, threshold: float, prefix: int, minutes: int) -> DataFrame:
    """(name, other): names of rows in neighbouring blocks that are similar, but neither equal nor of one beginning. Each two names are compared once; a row's own name comes first, as the measure depends on the order."""
    cells = rows.select("name", block_number(F.col("start"), minutes).alias("sb"), block_number(F.col("end"), minutes).alias("eb")).distinct()
    shifts = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    around = cells.withColumn("ds", F.explode(shifts)).withColumn("de", F.explode(shifts)).select("name", (F.col("sb") + F.col("ds")).alias("sb"), (F.col("eb") + F.col("de")).alias("eb"))
    a, b = F.length("name"), F.length("other")
    met = around.join(cells.withColumnRenamed("name", "other"), ["sb", "eb"]).filter(F.col("name") != F.col("other")).select("name", "other").distinct()
    # Twice the shorter over both lengths bounds the measure.
    met = met.filter((2 * F.least(a, b) >= threshold * (a + b)) & ~same_prefix(F.col("name"), F.col("other"), prefix))
    return met.filter(similarity(F.col("name"), F.col("other")) >= threshold)


def prefix_groups(df: DataFrame, *, id_col: str, name_col: str, length: int, within_cols: Sequence[str] = ()) -> DataFrame:
    """(within, id, group, members, links, shared) of the rows whose names begin with the same ``length`` characters as another's of the same ``within``.

    ``group`` is its smallest id, ``links`` the row's number of such others, ``shared`` how many leading characters all of the group's names share: that is what
    the first and the last of them in order share, so no two rows meet. Shorter names and null ones have no group.
    """
    need(df, id_col, name_col, *within_cols)
    rows = df.select(*within_cols, F.col(id_col).alias("id"), F.col(name_col).alias("_name")).filter(F.length("_name") >= length).withColumn("_prefix", F.left("_name", F.lit(length)))
    keys = [*within_cols, "_prefix"]
    each = rows.groupBy(*keys).agg(F.min("id").alias("group"), F.count("*").alias("members"), common_prefix_length(F.min("_name"), F.max("_name")).cast("long").alias("shared")).filter("members > 1")
    found = rows.join(each, keys)
    return found.select(*within_cols, "id", "group", "members", (F.col("members") - 1).alias("links"), "shared")


def annotate_suppression(
    df: DataFrame,
    *,
    start_col: str = "First_Anomaly_Time",
    end_col: str = "Last_Anomaly_Time",
    description_col: str = "Description",
    id_col: str = "Description",
    similarity_threshold: float = 0.85,
    prefix_threshold: int = 15,
    tolerance_min: int = 5,
    enabled: bool = True,
) -> DataFrame:
    """Adds ``Suppressed`` and ``Suppression_Reason``: the first peer by block and name that is near in time and alike in name.

    Names are alike if both have characters and are equal, share a prefix, or reach the similarity; the row's own
    name comes first there, as the measure depends on the order. ``id_col`` names the rows; rows of one id are no peers. Rows without times have none.
    """
    need(df, start_col, end_col, description_col, id_col)
    if not enabled:
        return df.withColumn("Suppressed", F.lit(False)).withColumn("Suppression_Reason", F.lit(None).cast("string"))
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(description_col), F.lit("")).alias("name"), F.col(start_col).alias("start"), F.col(end_col).alias("end")).filter("name <> ''")
    alike = alike_names(rows, threshold=similarity_threshold, prefix=prefix_threshold, minutes=tolerance_min)
    first = first_peers(rows, alike, prefix=prefix_threshold, minutes=tolerance_min).withColumnRenamed("peer", "_peer")
    rows = df.join(first.withColumnRenamed("id", "_id"), df[id_col] == F.col("_id"), "left").drop("_id")
    return rows.withColumn("Suppressed", F.col("_peer").isNotNull()).withColumn("Suppression_Reason", F.when(F.col("_peer").isNotNull(), F.concat(F.lit("clustered_with: "), F.col("_peer").cast("string")))).drop("_peer")
