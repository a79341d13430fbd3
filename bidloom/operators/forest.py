"""A4: isolation forest. Trees are grown on bounded samples (``sample`` rows each, a documented parameter); every row is scored."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, SAMPLE, LEAST = 160, 256, 30


def mean_depth(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(x: np.ndarray, rng: np.random.Generator, deepest: int) -> list[tuple]:
    """A tree as a list of (feature, cut, left, right) or (-1, depth, 0, 0)."""
    nodes: list[tuple] = []

    def split(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(())
        lo, hi = rows.min(0), rows.max(0)
        free = np.flatnonzero(hi > lo)
        if depth >= deepest or len(rows) <= 1 or not len(free):
            nodes[at] = (-1, depth + mean_depth(len(rows)), 0, 0)
            return at
        f = int(rng.choice(free))
        cut = float(rng.uniform(lo[f], hi[f]))
        low = rows[:, f] < cut
        nodes[at] = (f, cut, split(rows[low], depth + 1), split(rows[~low], depth + 1))
        return at

    split(x, 0)
    return nodes


def depths(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        f, cut, a, b = tree[at]
        if f < 0:
            out[rows] = cut
        else:
            low = x[rows, f] < cut
            todo += [(a, rows[low]), (b, rows[~low])]
    return out


def isolation_scores(df: DataFrame, key: str, features: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """``df`` with ``isolation``: 2 ** (-mean depth / expected depth), near 1 for outliers; null for fewer than ``LEAST`` rows. Null features count as 0."""
    filled = df.withColumns({f"__f{i}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for i, f in enumerate(features)})
    names = [f"__f{i}" for i in range(len(features))]
    rows = filled.count()
    share = min(1_000_000, -(-trees * sample * 1_000_000 // max(rows, 1)))  # by hash, so that no task sorts the rows of all
    take = filled.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < share).select(*names, F.xxhash64(F.col(key)).alias("__h")).toPandas().sort_values(["__h", *names])[names].to_numpy(float)
    if len(take) < LEAST:
        return df.withColumn("isolation", F.lit(None).cast("double"))
    rng = np.random.default_rng(seed)
    size = min(sample, len(take))
    deepest = int(np.ceil(np.log2(max(size, 2))))
    forest = [grow(take[rng.choice(len(take), size, replace=False)], rng, deepest) for _ in range(trees)]
    expected = mean_depth(size)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        return pd.Series(2 ** (-np.mean([depths(t, x) for t in forest], axis=0) / expected))

    return filled.withColumn("isolation", score(*names)).drop(*names)


def outlier_signal(df: DataFrame, score: str = "isolation") -> DataFrame:
    """Scores placed between their 5th and 95th percentile, 0..1, as ``signal``."""
    q = df.select(F.percentile_approx(score, F.array(F.lit(0.05), F.lit(0.95)), 100_000).alias("__q"))  # exact to a hundred thousandth of the rows
    s = (F.col(score) - F.col("__q")[0]) / (F.col("__q")[1] - F.col("__q")[0])
    return df.crossJoin(F.broadcast(q)).withColumn("signal", F.when(F.col("__q")[1] > F.col("__q")[0], F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))).otherwise(0.0)).drop("__q")
