"""Isolation forest (Liu, Ting and Zhou, 2008) on Spark.

Every tree sees the ``sample`` rows with its smallest draws, at any size of the table: draws are
hashes of the row's keys, so they are the same on every run and no group grows with the data. The node table has a fixed upper size
(trees x 511 nodes) and is what scoring ships to the executors.
"""

import hashlib
import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfold.functions import hashing
from scanfold.operators.features import feature_columns
from scanfold.sources.workspace import stored
from scanfold.values import rules as R

NODE_SCHEMA = "tree_id int, node_id int, feature int, threshold double, size int"
OVERSAMPLE = 2

# Executors get these functions by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tree_samples(rows: DataFrame, keys: list, trees: int, sample: int, seed: int) -> DataFrame:
    """The rows that can be among the ``sample`` smallest draws of each tree, with tree_id and draw.

    A bound on the draws lets through about twice as many rows per tree, and no row is copied
    before it is known to be drawn. Should a tree get too few, the bound is doubled, so the
    smallest draws are always complete. Equal draws are ordered by the keys.
    """
    total = rows.count()
    factors, offsets = zip(*[hashing.multipliers(seed, t) for t in range(trees)])

    def numbers(values):
        return F.expr(f"array({', '.join(f'{v}L' for v in values)})")

    hashed = rows.withColumns({"_h": F.expr(hashing.row_hash_sql(keys)), "_a": numbers(factors), "_b": numbers(offsets)})
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree_id"), ((F.get("_a", t) * F.col("_h") + F.get("_b", t)) % hashing.PRIME).alias("draw")))
    share = sample * OVERSAMPLE / max(total, 1)
    while True:
        bound = hashing.PRIME if share >= 1 else int(hashing.PRIME * share)
        drawn = hashed.withColumn("_d", F.explode(F.filter(draws, lambda d: d["draw"] < bound))).select(
            *rows.columns, "_d.tree_id", "_d.draw")
        drawn = stored(drawn, "tree-samples")
        state = drawn.groupBy("tree_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("trees"), F.min("n").alias("least")).first()
        if bound == hashing.PRIME or (state.trees == trees and state.least >= min(sample, total)):
            return drawn
        share *= 2


def smallest_draws(drawn: DataFrame, keys: list, sample: int) -> DataFrame:
    """Exactly the rows that each tree grows on."""
    order = W.partitionBy("tree_id").orderBy("draw", *keys)
    return drawn.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= sample).drop("_place")


def _share(seed: int, tree_id: int, node: int, part: str) -> float:
    """A number in [0, 1) by rule: the first 32 bits of an MD5 of the node's place."""
    return int(hashlib.md5(f"{seed}|{tree_id}|{node}|{part}".encode()).hexdigest()[:8], 16) / 2 ** 32


def _grow(tree_id: int, data: np.ndarray, seed: int) -> list:
    """Nodes of one random tree; children of node i are 2i+1 and 2i+2.

    A node's feature and threshold are drawn from its place in the tree, so a tree depends on
    its rows and the seed alone.
    """
    depth_limit = max(1, math.ceil(math.log2(max(len(data), 2))))
    nodes, stack = [], [(0, data, 0)]
    while stack:
        node, part, depth = stack.pop()
        low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (None, None)
        usable = np.flatnonzero(high > low) if len(part) > 1 else []
        if depth >= depth_limit or len(usable) == 0:
            nodes.append((tree_id, node, -1, 0.0, len(part)))
            continue
        feature = int(usable[int(_share(seed, tree_id, node, "feature") * len(usable))])
        threshold = float(low[feature] + (high[feature] - low[feature]) * _share(seed, tree_id, node, "threshold"))
        left = part[:, feature] <= threshold
        nodes.append((tree_id, node, feature, threshold, len(part)))
        stack.append((2 * node + 2, part[~left], depth + 1))
        stack.append((2 * node + 1, part[left], depth + 1))
    return nodes


def fit_forest(features: DataFrame, keys: list | None = None, trees: int = R.FOREST_TREES,
               sample: int = R.FOREST_SAMPLE, seed: int = R.SEED) -> DataFrame:
    """Node table of the forest; unsupervised, over all feature rows."""
    keys = keys or ["scan_id", "ip"]
    names = feature_columns()
    drawn = tree_samples(features.select(*keys, *names), keys, trees, sample, seed)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        chosen = rows.sort_values(["draw", *keys]).head(sample)
        data = chosen[names].to_numpy(dtype="float64")
        grown = _grow(int(rows["tree_id"].iloc[0]), data, seed)
        return pd.DataFrame(grown, columns=["tree_id", "node_id", "feature", "threshold", "size"])

    return drawn.select("tree_id", "draw", *keys, *names).groupBy("tree_id").applyInPandas(
        build, NODE_SCHEMA)


def _path_constant(n):
    """Average path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 3.0)
    value = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, value, np.where(n == 2, 1.0, 0.0))


def _pack(nodes: pd.DataFrame) -> dict:
    """Node table as arrays indexed by tree and node."""
    trees = int(nodes["tree_id"].max()) + 1
    width = int(nodes["node_id"].max()) + 1
    feature = np.full((trees, width), -1, dtype="int32")
    threshold = np.zeros((trees, width))
    leaf = np.zeros((trees, width))
    t, n = nodes["tree_id"].to_numpy(), nodes["node_id"].to_numpy()
    feature[t, n] = nodes["feature"]
    threshold[t, n] = nodes["threshold"]
    depth = np.floor(np.log2(n + 1.0))
    leaf[t, n] = depth + _path_constant(nodes["size"].to_numpy())
    root = nodes[nodes["node_id"] == 0]
    return {"feature": feature, "threshold": threshold, "leaf": leaf,
            "levels": int(depth.max()), "norm": float(_path_constant(root["size"].max()))}


def score_forest(features: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``raw_score`` in [-1, 0); lower is more anomalous."""
    names = feature_columns()
    forest = features.sparkSession.sparkContext.broadcast(_pack(nodes.toPandas()))

    @F.pandas_udf(T.DoubleType())
    def raw_score(*columns: pd.Series) -> pd.Series:
        f = forest.value
        data = np.column_stack([c.to_numpy(dtype="float64") for c in columns])
        row = np.arange(len(data))
        total = np.zeros(len(data))
        for tree in range(len(f["feature"])):
            node = np.zeros(len(data), dtype="int64")
            for _ in range(f["levels"]):
                feature = f["feature"][tree, node]
                right = data[row, np.maximum(feature, 0)] > f["threshold"][tree, node]
                node = np.where(feature >= 0, 2 * node + 1 + right, node)
            total += f["leaf"][tree, node]
        norm = f["norm"] if f["norm"] > 0 else 1.0
        return pd.Series(-np.power(2.0, -(total / len(f["feature"])) / norm))

    return features.withColumn("raw_score", raw_score(*[F.col(n) for n in names]))
