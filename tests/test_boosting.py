"""Best rounds, row attributions and balanced folds against brute force."""

import heapq
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestlens.operators import attributions, boosting, models, splits

NAMES = ["a", "b", "c", "d", "e", "f"]
ROW = ["id"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for i in range(600):
        x = [rng.uniform(0, 10) for _ in NAMES]
        y = 3 * x[0] + (8 if x[1] > 5 else 0) * (x[2] > 3) - x[3] + rng.gauss(0, 4)
        out.append((i, *(None if rng.random() < 0.02 else v for v in x), y))
    return spark.createDataFrame(out, "id int, " + ", ".join(f"{n} double" for n in NAMES) + ", y double").cache()


def test_best_round_waits_for_patience():
    assert boosting.best_round([5, 4, 3, 3.5, 2, 9, 9, 9], 3) == (5, 8)
    assert boosting.best_round([5, 4, 3, 3.5, 3.2, 3.1, 2], 3) == (3, 6)
    assert boosting.best_round([1, 2, 3], 50) == (1, 3)
    assert boosting.best_round([2, 2, 2, 2], 2) == (1, 3)
    losses = [100 - 5 * i if i < 12 else 50 + i for i in range(100)]
    assert boosting.best_round(losses, 50) == (12, 62)
    assert boosting.best_round([], 5) == (0, 0)


def test_the_model_is_cut_to_the_best_round(spark, rows):
    s = models.BoostSettings(rounds=100, depth=4, step=0.4, min_rows=2, patience=100)
    fit = models.fit_boosted(rows, NAMES, "y", ROW, s)
    assert len(fit.losses) == 100 and fit.losses[fit.best - 1] == min(fit.losses) and 1 < fit.best < 100
    kept = fit.model.stages[-1]
    assert kept.getNumTrees == fit.best
    # the cut model's loss on the held-out rows is that of its round
    held = splits.validation_rows(rows, models.VALIDATION_SHARE, ROW, "held").filter("held")
    loss = fit.model.transform(held).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    assert loss == pytest.approx(fit.losses[fit.best - 1], rel=1e-9)
    table = fit.table(spark)
    assert table.filter("kept").count() == fit.best and table.count() == 100
    assert models.fit_boosted(rows, NAMES, "y", ROW, models.BoostSettings(rounds=100, depth=4, step=0.4, min_rows=2, patience=1)).best <= fit.best


def test_a_given_round_is_kept(rows):
    s = models.BoostSettings(rounds=20, depth=3, step=0.3, min_rows=2)
    full = models.fit_boosted(rows, NAMES, "y", ROW, s)
    short = models.fit_boosted(rows, NAMES, "y", ROW, models.BoostSettings(rounds=12, depth=3, step=0.3, min_rows=2))
    if full.best >= 12:
        trees = full.model.stages[-1]
        cut = boosting.first_rounds(trees, 12)
        assert cut.getNumTrees == 12 and cut.numFeatures == trees.numFeatures and cut.getPredictionCol() == trees.getPredictionCol()
        assert cut.treeWeights == trees.treeWeights[:12] and short.losses == pytest.approx(full.losses[:12])
    with pytest.raises(ValueError):
        boosting.first_rounds(full.model.stages[-1], 0)


def test_without_held_out_rows_all_rounds_stay(rows):
    s = models.BoostSettings(rounds=4, depth=2, min_rows=1)
    fit = models.fit_boosted(rows.filter("id < 3"), NAMES, "y", ROW, s)
    assert fit.model.stages[-1].getNumTrees == fit.best


def expected(nodes, x, known):
    """A tree's mean prediction when only the features in `known` are given."""
    def down(i):
        n = nodes[i]
        if n["feature"] is None:
            return n["value"]
        if n["feature"] in known:
            return down(n["low"] if x[n["feature"]] <= n["threshold"] else n["high"])
        low, high = nodes[n["low"]], nodes[n["high"]]
        return (down(n["low"]) * low["cover"] + down(n["high"]) * high["cover"]) / n["cover"]

    return down(0)


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_attributions_by_enumeration(spark, rows, kind):
    if kind == "forest":
        model = models.fit_rf(rows, NAMES, "y", models.ForestSettings(trees=4, depth=5))
    else:
        model = models.fit_boosted(rows, NAMES, "y", ROW, models.BoostSettings(rounds=6, depth=5, step=0.5, min_rows=1)).model
    got = attributions.attributions(model, rows.withColumn("value", F.lit("x")), NAMES).collect()
    assert len(got) == 600
    assert max(abs(sum(r["attributions"].values()) + r["base_value"] - r["prediction"]) for r in got) < 1e-9
    trees = {}
    for n in attributions.node_table(model, spark).collect():
        trees.setdefault(n["tree"], {})[n["node"]] = n.asDict()
    filled = {r["id"]: list(r["__features"]) for r in model.transform(rows).select("id", "__features").collect()}
    m = len(NAMES)
    for r in random.Random(1).sample(got, 12):
        x = filled[r["id"]]
        worth = {}
        for size in range(m + 1):
            for s in combinations(range(m), size):
                worth[s] = sum(expected(t, x, s) * t[0]["weight"] for t in trees.values())
        assert worth[()] == pytest.approx(r["base_value"], abs=1e-9)
        for i, name in enumerate(NAMES):
            rest = [j for j in range(m) if j != i]
            want = sum(
                math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m) * (worth[tuple(sorted((*s, i)))] - worth[s])
                for size in range(m) for s in combinations(rest, size)
            )
            assert r["attributions"][name] == pytest.approx(want, abs=1e-9)


def test_worst_row_and_mean_sizes(rows):
    model = models.fit_rf(rows, NAMES, "y", models.ForestSettings(trees=3, depth=3))
    out = attributions.attributions(model, rows, NAMES).cache()
    worst = attributions.worst_row(out, "y", ROW).collect()
    gap = out.select("id", F.abs(F.col("y") - F.col("prediction")).alias("gap")).orderBy(F.col("gap").desc(), "id").first()
    assert {r["id"] for r in worst} == {gap["id"]} and len(worst) == len(NAMES)
    sizes = [abs(r["value"]) for r in worst]
    assert sizes == sorted(sizes, reverse=True)
    mean = {r["feature"]: r["mean_abs"] for r in attributions.mean_attribution(out).collect()}
    values = [r["attributions"] for r in out.collect()]
    assert mean == pytest.approx({n: sum(abs(v[n]) for v in values) / len(values) for n in NAMES})


def test_a_tree_without_splits_attributes_nothing(spark):
    flat = spark.createDataFrame([(i, float(i % 2), 7.0) for i in range(20)], "id int, a double, y double")
    model = models.fit_rf(flat, ["a"], "y", models.ForestSettings(trees=2, depth=2))
    assert {(r["base_value"], r["attributions"]["a"]) for r in attributions.attributions(model, flat, ["a"]).collect()} == {(7.0, 0.0)}


def test_path_values_sum_to_what_passes():
    share = np.array([0.5, 0.2, 0.9])
    passed = np.array([[1, 1, 1], [0, 1, 1], [0, 0, 0], [1, 0, 1]], float)
    total = attributions.path_values(passed, share).sum(axis=1)
    assert np.allclose(total, passed.prod(axis=1) - share.prod())


def greedy(sizes, k):
    heap = [(0, f) for f in range(k)]
    out = {}
    for rows, many in sorted(sizes, reverse=True):
        for _ in range(many):
            load, f = heapq.heappop(heap)
            out[rows, f] = out.get((rows, f), 0) + 1
            heapq.heappush(heap, (load + rows, f))
    return out


def test_packing_equals_one_by_one():
    rng = random.Random(9)
    for _ in range(300):
        sizes = [(s, rng.choice([1, 1, 2, 5, 40])) for s in rng.sample(range(1, 60), rng.randint(1, 12))]
        k = rng.randint(1, 7)
        assert {(s, f): to - start for s, f, start, to in splits.packed(sizes, k)} == greedy(sizes, k)


def test_folds_are_balanced_with_a_heavy_entity(spark):
    rng = random.Random(2)
    entities = [("big", None, 3000), (None, 1, 40), *((f"c{i}", i % 3, rng.choice([1, 1, 1, 10, 50, 77])) for i in range(400))]
    rows = [(a, b, j) for a, b, n in entities for j in range(n)]
    df = spark.createDataFrame(rows, "a string, b int, n int")
    out = splits.balanced_folds(df, ["a", "b"], 5).cache()
    assert out.columns == ["a", "b", "n", "fold"] and out.count() == len(rows)
    loads = {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()}
    assert out.groupBy("a", "b").agg(F.count_distinct("fold").alias("f")).filter("f > 1").count() == 0
    others = [n for f, n in loads.items() if n != max(loads.values())]
    assert max(loads.values()) - min(loads.values()) <= 3000 and max(others) - min(others) <= 77
    want = {}
    for (size, f), n in greedy([(s, sum(e[2] == s for e in entities)) for s in {e[2] for e in entities}], 5).items():
        want[f] = want.get(f, 0) + size * n
    assert loads == want
    assert splits.balanced_folds(df.limit(0), ["a", "b"]).count() == 0
