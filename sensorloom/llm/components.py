"""Connected components of a graph that is given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, temporary


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node that can be reached, for each node of ``pairs`` (u, v: long).

    Each round takes the smallest label among the neighbours and then that label's own label, so long chains
    halve. Rounds are written to the shared folder, and stay there until the last one is done; no links or labels get to the
    driver, only a count. A node with very many neighbours is no hot key for the minimum (Spark sums up before the
    shuffle) and a split partition for the join. No pairs, or only pairs of equal nodes: an empty result.
    """
    spark = pairs.sparkSession
    with temporary(spark):
        both = kept(pairs.filter("u <> v").select("u", "v").union(pairs.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "pairs")
        labels = kept(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
        while True:
            near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
            step = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
            new = kept(step.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
            labels = new.select("node", "label")
            if new.filter("label <> was").limit(1).count() == 0:
                return kept(labels, "components", keep=True)
