"""What each feature adds to a tree model's prediction of a row: exact Shapley values over the paths of the fitted trees.

A feature that is left out of a coalition sends a row down both branches of a split, each with the share of training rows that went there. So a leaf adds to a
coalition its value, once for each present feature that lets the row through and times the shares of the absent ones. The leaves' paths come from the node
table of the fitted model by joining nodes with their children, level by level. A path has as many features as the tree is deep at most, and rows that pass the same
splits of a path share their values, which are computed once for each batch.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, functions as F

from harvestlens.session import fresh_folder, materialize

# What runs on executors travels by value, so that this package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
STEP = "struct<feature:int,least:double,most:double,share:double>"


def node_table(model: PipelineModel, spark) -> DataFrame:
    """(tree, node, feature, threshold, low, high, cover, value, weight) of every node of a forest or of boosted trees, as the written model holds them: rows up to
    the threshold go to `low`, the others to `high`; a leaf has no feature. `cover` counts training rows, `weight` is the tree's part in a prediction."""
    trees, place = model.stages[-1], fresh_folder(spark, "model")
    trees.write().save(place)
    data = spark.read.load(f"{place}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    # a forest averages its trees, boosted trees add up by their weights
    parts = trees.treeWeights if isinstance(trees, GBTRegressionModel) else [1.0 / trees.getNumTrees] * trees.getNumTrees
    weights = spark.createDataFrame([(i, float(w)) for i, w in enumerate(parts)], "tree int, weight double")
    leaf = F.col("leftChild") < 0
    return data.join(weights, "tree").select(
        F.col("tree").cast("int"), F.col("id").cast("int").alias("node"), F.when(~leaf, F.col("split.featureIndex")).alias("feature"),
        F.when(~leaf, F.element_at("split.leftCategoriesOrThreshold", 1)).alias("threshold"), F.col("leftChild").cast("int").alias("low"),
        F.col("rightChild").cast("int").alias("high"), F.element_at("impurityStats", 1).alias("cover"), F.col("prediction").alias("value"), "weight",
    )


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, value, weight, steps) of every leaf. A step has a feature of the path with the open lower and closed upper end that all its splits leave, and the
    share of training rows that they let through; each feature is in a path once."""
    at = nodes.filter("node = 0").select("tree", "node", F.expr(f"CAST(array() AS array<{STEP}>)").alias("steps"))
    done = None
    parent = nodes.select("tree", "node", "feature", "threshold", "low", "high", "cover")
    child = nodes.select("tree", F.col("node").alias("next"), F.col("cover").alias("below"))
    while True:
        held = at.join(nodes.select("tree", "node", "feature", "value", "weight"), ["tree", "node"])
        ended = held.filter("feature IS NULL").select("tree", "value", "weight", "steps")
        done = ended if done is None else done.unionByName(ended)
        inner = at.join(parent.filter("feature IS NOT NULL"), ["tree", "node"])
        if not inner.head(1):
            return done
        inf = F.lit(float("inf"))
        ways = F.array(
            F.struct(F.col("low").alias("next"), (-inf).alias("least"), F.col("threshold").alias("most")),
            F.struct(F.col("high").alias("next"), F.col("threshold").alias("least"), inf.alias("most")),
        )
        moved = inner.select("tree", "steps", "feature", "cover", F.explode(ways).alias("way")).select("tree", "steps", "feature", "cover", "way.*").join(child, ["tree", "next"])
        share = F.col("below") / F.col("cover")
        again = F.exists("steps", lambda s: s["feature"] == F.col("feature"))
        tighter = F.transform("steps", lambda s: F.when(s["feature"] == F.col("feature"), F.struct(
            s["feature"].alias("feature"), F.greatest(s["least"], F.col("least")).alias("least"), F.least(s["most"], F.col("most")).alias("most"), (s["share"] * share).alias("share"),
        )).otherwise(s))
        new = F.concat("steps", F.array(F.struct("feature", "least", "most", share.alias("share"))))
        # as many paths as a level has nodes; a model's depth bounds the rounds
        at = materialize(moved.select("tree", F.col("next").alias("node"), F.when(again, tighter).otherwise(new).alias("steps")))


@dataclass(frozen=True)
class Path:
    """A leaf: its part in a prediction, and of each feature on the way its number, bounds and share."""

    value: float
    feature: np.ndarray
    least: np.ndarray
    most: np.ndarray
    share: np.ndarray


def path_values(passed: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1 for rows that pass (1) or fail (0) each feature of its path.

    The coalitions of the other features add, by their size k, the coefficients of a product of (share + passed * t), weighted by k! (m - k - 1)! / m!."""
    m = len(share)
    out = np.empty(passed.shape)
    weight = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])
    for i in range(m):
        by_size = np.zeros((len(passed), m))
        by_size[:, 0] = 1
        for j in range(m):
            if j != i:
                more = by_size[:, :-1] * passed[:, j : j + 1]
                by_size *= share[j]
                by_size[:, 1:] += more
        out[:, i] = by_size @ weight * (passed[:, i] - share[i])
    return out


def shapley(rows: np.ndarray, paths: Sequence[Path]) -> np.ndarray:
    """Values of every feature (column) for every row, summed over the leaves."""
    out = np.zeros(rows.shape)
    for p in paths:
        m = len(p.feature)
        own = rows[:, p.feature]
        code = ((own > p.least) & (own <= p.most)) @ (1 << np.arange(m))
        seen = np.unique(code)
        values = path_values((seen[:, None] >> np.arange(m) & 1).astype(float), p.share) * p.value
        out[:, p.feature] += values[np.searchsorted(seen, code)]
    return out


def paths_of(leaves: DataFrame) -> tuple[list[Path], float]:
    """The leaves' paths for the executors, and the mean prediction. As many rows as the fitted trees have leaves; the driver holds the trees as well."""
    out, base = [], 0.0
    for r in leaves.collect():
        s = r["steps"]
        value, share = r["value"] * r["weight"], np.array([x["share"] for x in s])
        base += value * float(share.prod())
        if s:
            out.append(Path(value, np.array([x["feature"] for x in s]), np.array([x["least"] for x in s]), np.array([x["most"] for x in s]), share))
    return out, base


def attributions(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str = "attributions") -> DataFrame:
    """The rows with `prediction`, `base_value` (the mean prediction over the training rows) and a map of each feature's value: per row they add up to the prediction
    minus the base value. Gaps are filled as the model fills them."""
    paths, base = paths_of(leaf_paths(node_table(model, df.sparkSession)))

    @F.pandas_udf("array<double>")
    def explained(rows: pd.Series) -> pd.Series:
        return pd.Series(list(shapley(np.stack(rows.to_list()), paths))) if len(rows) else pd.Series([], dtype=object)

    known = model.transform(df)
    values = explained(vector_to_array(F.col("__features")))
    shown = F.map_from_arrays(F.array(*[F.lit(f) for f in features]), values)
    return known.select(*df.columns, "prediction", F.lit(base).alias("base_value"), shown.alias(name))


def mean_attribution(rows: DataFrame, name: str = "attributions") -> DataFrame:
    """Mean size of each feature's values over the rows."""
    return rows.select(F.explode(name).alias("feature", "value")).groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean"))


def worst_row(rows: DataFrame, label: str, key: Sequence[str], name: str = "attributions") -> DataFrame:
    """The row that is predicted worst, as one row a feature from the largest to the smallest effect; ties go to the smallest key."""
    gap = F.abs(F.col(label) - F.col("prediction"))
    one = rows.filter(gap.isNotNull()).orderBy(gap.desc(), *key).limit(1)
    shown = one.select(*key, label, "prediction", "base_value", F.explode(name).alias("feature", "value"))
    return shown.orderBy(F.abs("value").desc(), "feature")
