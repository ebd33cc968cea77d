"""Isolation forest for each series (Liu, Ting and Zhou, 2008).

Spark has no such model. A tree sees at most 256 rows, so a series' trees are fitted on a seeded sample of at most
``SAMPLED`` of its rows, in one group a series; the rows are dealt out in parts of ``SCORED``, and stream by the trees, which each part gets once,
so a long series is scored by many tasks. A series that fails gives its rows with the error, and does not stop the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from .quantiles import exact_quantiles
from .windows import contamination, in_blocks, joined_back, own_rows, rolling_features

SAMPLE = 256
#: Rows of a series that its trees may draw from.
SAMPLED = 8192
#: Rows of a series that one task scores.
SCORED = 250_000
FEATURES = ("f_diff", "f_mean", "f_std", "f_slope")
#: A node: the column that it cuts (-1 for a leaf), where, its left child (the right one is next), and a leaf's depth.
NODE = np.dtype([("column", "<i2"), ("cut", "<f8"), ("left", "<i4"), ("depth", "<f4")])


def _expected(n: int) -> float:
    """Mean depth of an unsuccessful search among n values."""
    return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def _tree(rows: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """The nodes level by level."""
    queue, nodes = [(rows, 0)], []
    for inside, depth in queue:  # grows while it is read
        spread = np.ptp(inside, axis=0) if depth < limit and len(inside) > 1 else np.zeros(1)
        wide = np.flatnonzero(spread > 0)
        if not len(wide):
            nodes.append((-1, 0.0, 0, depth + _expected(len(inside))))
            continue
        column = wide[rng.integers(len(wide))]
        cut = rng.uniform(inside[:, column].min(), inside[:, column].max())
        nodes.append((column, cut, len(queue), 0.0))
        below = inside[:, column] < cut
        queue += [(inside[below], depth + 1), (inside[~below], depth + 1)]
    return np.array(nodes, NODE)


def fit(x: np.ndarray, trees: int = 200, seed: int = 42, sample: int = SAMPLE) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))
    return [_tree(x[rng.choice(len(x), size, replace=False)], limit, rng) for _ in range(trees)]


@dataclass(frozen=True)
class Nodes:
    """All trees' nodes side by side; a leaf leads to itself."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    steps: int

    @classmethod
    def of(cls, nodes: np.ndarray, sizes: Sequence[int]) -> Nodes:
        roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        leaf, own = nodes["column"] < 0, np.arange(len(nodes))
        left = np.where(leaf, own, nodes["left"] + np.repeat(roots, sizes))
        return cls(np.where(leaf, 0, nodes["column"]).astype(np.int64), np.where(leaf, np.inf, nodes["cut"]), left, nodes["depth"].astype(float), roots, int(np.ceil(np.log2(max(SAMPLE, 2)))))

    def scores(self, x: np.ndarray, size: int) -> np.ndarray:
        """The anomaly score of each row, near 1 for rows that few cuts set apart."""
        depth, flat, row = np.zeros(len(x)), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            for _ in range(self.steps):
                at = self.left[at] + (flat[row + self.column[at]] >= self.cut[at])
            depth += self.depth[at]
        return 2.0 ** (-depth / len(self.roots) / max(_expected(size), 1e-9))


def forest_scores(x: np.ndarray, trees: int = 200, seed: int = 42, sample: int = SAMPLE) -> np.ndarray:
    forest = fit(x, trees, seed, sample)
    return Nodes.of(np.concatenate(forest), [len(t) for t in forest]).scores(x, min(sample, len(x)))


def _values(rows: pd.DataFrame, columns: list[str]) -> np.ndarray:
    return np.nan_to_num(rows[columns].to_numpy(float), posinf=0.0, neginf=0.0)


def _fitter(keys: list[str], columns: list[str], trees: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[keys].iloc[:1].copy()
        try:
            rows = rows.sort_values("rn")
            own = int.from_bytes(hashlib.sha256("\x1f".join(map(str, rows[keys].iloc[0])).encode()).digest()[:4], "big")
            forest = fit(_values(rows, columns), trees, seed ^ own)
            return out.assign(sizes=[[len(t) for t in forest]], nodes=[np.concatenate(forest).tobytes()], fitted=len(rows), ISO_Error=None)
        except Exception as e:  # the dead letter of one series
            return out.assign(sizes=[[]], nodes=[b""], fitted=0, ISO_Error=f"{type(e).__name__}: {e}")

    return grow


def _scorer(keys: list[str], columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Sorted rows, those with a series' trees before those that they score, which stream by."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, size, error = None, 0, "no trees"
        for batch in batches:
            trees = np.flatnonzero(batch["fitted"].to_numpy() >= 0)
            cuts = [0, *trees.tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = batch.iloc[a:b]
                if a < b and rows["fitted"].iat[0] >= 0:
                    own, rows = rows.iloc[0], rows.iloc[1:]
                    forest, size, error = None, min(SAMPLE, int(own["fitted"])), own["ISO_Error"]
                    if error is None:
                        forest = Nodes.of(np.frombuffer(own["nodes"], NODE), own["sizes"])
                if not len(rows):
                    continue
                out = rows[[*keys, "rn"]]
                try:
                    yield out.assign(ISO_Score=forest.scores(_values(rows, columns), size) if error is None else 0.0, ISO_Error=error)
                except Exception as e:
                    yield out.assign(ISO_Score=0.0, ISO_Error=f"{type(e).__name__}: {e}")

    return score


def isolation_flags(points: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, *, trees: int = 200, seed: int = 42, window: int = 12, base: float = 0.01) -> DataFrame:
    """(keys, rn, ISO_Score, ISO_Flag, ISO_Error, ISO_Cont): the estimated share of rows with the highest scores. Needs ``rn`` and ``n``; ``points`` should be a written table."""
    keys, columns = list(keys), [value, *FEATURES]
    typed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema if f.name in keys)
    share = written(contamination(points, keys, order, value, base=base).select(*keys, F.col("cont").alias("ISO_Cont")), "shares")
    rows = own_rows(rolling_features(in_blocks(points, halo=window + 1), [*keys, "_block"], order, value, window))
    rows = written(rows.select(*keys, "rn", "n", *columns), "features")
    # About twice the rows that are wanted come by chance, of which the first are taken.
    draw = F.xxhash64(*keys, "rn", F.lit(seed))
    some = rows.filter(F.pmod(draw, F.col("n")) < 2 * SAMPLED).withColumn("_draw", draw)
    some = some.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy("_draw", "rn"))).filter(F.col("_place") <= SAMPLED)
    forests = some.select(*keys, "rn", *columns).groupBy(*keys).applyInPandas(_fitter(keys, columns, trees, seed), f"{typed}, sizes array<int>, nodes binary, fitted int, ISO_Error string")
    forests = written(forests, "forests")
    # A series' rows go to tasks of SCORED rows, each of which gets the trees once, before its rows.
    parts = rows.groupBy(*keys).agg(F.max("rn").alias("_last")).select(*keys, F.explode(F.sequence(F.lit(0), F.floor(F.col("_last") / SCORED))).alias("_part"))
    first = joined_back(parts, forests, keys).withColumn("rn", F.lit(-1))
    rest = rows.drop("n").withColumns({"_part": F.floor(F.col("rn") / SCORED), "fitted": F.lit(-1)})
    dealt = first.unionByName(rest, allowMissingColumns=True).repartition(*keys, "_part").sortWithinPartitions(*keys, "_part", "rn")
    scored = written(dealt.mapInPandas(_scorer(keys, columns), f"{typed}, rn int, ISO_Score double, ISO_Error string"), "scored")
    known = joined_back(scored, share, keys)
    limits = exact_quantiles(known, keys, {"_limit": (F.col("ISO_Score"), (1 - F.col("ISO_Cont"), 0.95, 0.999))})
    flat = rows.groupBy(*keys).agg(F.stddev_pop(value).alias("_sd"))
    done = joined_back(known, limits.join(flat, keys), keys)
    varied = F.coalesce(F.col("_sd") > 1e-9, F.lit(False))
    flag = varied & F.col("ISO_Error").isNull() & (F.col("ISO_Score") > F.col("_limit"))
    return done.select(*keys, "rn", F.when(varied, F.col("ISO_Score")).otherwise(F.lit(0.0)).alias("ISO_Score"), F.coalesce(flag, F.lit(False)).alias("ISO_Flag"), "ISO_Error", "ISO_Cont")


def failed(flags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ISO_Error) of the series that could not be scored."""
    return flags.filter(F.col("ISO_Error").isNotNull()).groupBy(*keys).agg(F.first("ISO_Error").alias("ISO_Error"))
