from functools import partial

import numpy as np
from harvestlens.llm import mixing
from pyspark.sql import functions as F


def shares(rows):
    total = sum(r["words"] for r in rows)
    return {d: sum(r["rate"] * r["words"] * r["posteriors"][d] for r in rows) / total for d in mixing.TARGETS}


def test_totals_meet_targets_and_the_classifier_knows_languages(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = mixing.mix(docs, mixing.labelled_languages(docs, labels)).collect()
    assert len(rows) == docs.count() and all(r["rate"] >= 0 for r in rows)
    assert all(r["words"] == len((r["text"] or "").encode().split()) for r in rows)
    assert np.mean([max(r["posteriors"], key=r["posteriors"].get) == r["lang"] for r in rows]) > 0.97
    got = shares(rows)
    assert all(abs(got[d] - t) < 1e-6 for d, t in mixing.TARGETS.items())


def whole(share, words):
    return lambda shape, part: part(share, words.astype(float))


def held_rows(spark, words, share):
    return spark.createDataFrame([(int(w), [float(x) for x in p]) for w, p in zip(words, share)], "words long, share array<double>").coalesce(2)


def squared_miss(share, words, rate, goal):
    return float((((share * (rate * words)[:, None]).sum(axis=0) / words.sum() - goal) ** 2).sum())


def least(share, words, goal):
    """Nonnegative least squares by active sets: the least squared miss of the domain totals."""
    a = (share * words[:, None]).T / words.sum()
    free = np.zeros(a.shape[1], bool)
    x = np.zeros(a.shape[1])
    for _ in range(500):
        slope = a.T @ (goal - a @ x)
        slope[free] = -np.inf
        if slope.max() < 1e-13:
            break
        free[slope.argmax()] = True
        while True:
            z = np.zeros_like(x)
            z[free] = np.linalg.lstsq(a[:, free], goal, rcond=None)[0]
            if z[free].min() > 0:
                break
            low = free & (z <= 0)
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            free &= x > 1e-13
            x[~free] = 0
        x = z
    return squared_miss(share, words, x, goal)


def test_rates_equal_nonnegative_least_squares(spark):
    """Few documents and lopsided targets, so that rates end at zero and some targets are out of reach."""
    rng = np.random.default_rng(4)
    unreached = off = 0
    for case in range(300):
        width = int(rng.integers(2, 5))
        share = rng.dirichlet([rng.choice([0.3, 0.7, 3.0])] * width, int(rng.choice([2, 3, 5, 30, 300])))
        words = rng.integers(1, 500, len(share))
        goal = rng.dirichlet([0.5] * width)
        steps = mixing.fit_rates(whole(share, words), goal)
        rate = mixing.rates_of(share, steps)
        if case < 8:
            far = mixing.fit_rates(partial(mixing._added, held_rows(spark, words, share), width), goal)
            assert squared_miss(share, words, mixing.rates_of(share, far), goal) < squared_miss(share, words, rate, goal) + 1e-9
        best = least(share, words, goal)
        unreached += best > 1e-6
        assert (rate >= 0).all() and squared_miss(share, words, rate, goal) < best + 1e-4, case
        off += squared_miss(share, words, rate, goal) > best + 1e-6
    # where posteriors are so alike that rates in the thousands would be needed, sums of squares tell no more
    assert unreached > 80 and off <= 1


def test_the_named_case(spark):
    share, words, goal = np.array([[0.9, 0.1], [0.6, 0.4]]), np.array([100, 100]), np.array([0.99, 0.01])
    rate = mixing.rates_of(share, mixing.fit_rates(whole(share, words), goal))
    assert np.allclose(rate, [0.892 / 0.41, 0], atol=1e-4) and abs(squared_miss(share, words, rate, goal) - 0.00988) < 1e-4


def test_targets_out_of_reach(spark):
    share = np.array([[1.0, 0.0], [1.0, 0.0]])
    rate = mixing.rates_of(share, mixing.fit_rates(partial(mixing._added, held_rows(spark, np.array([10, 20]), share), 2), np.array([0.5, 0.5])))
    assert np.allclose(rate, 0.5)
    assert mixing.fit_rates(partial(mixing._added, held_rows(spark, [10], share).limit(0), 2), np.array([0.5, 0.5])) == []


def test_odd_rows(spark, odd_docs, no_docs):
    labelled = odd_docs.select("doc_id", F.col("lang").alias("domain"))
    rows = mixing.mix(odd_docs, labelled).collect()
    assert len(rows) == 10 and {r["words"] for r in rows if not (r["text"] or "").strip()} == {0}
    assert rows[0].asDict().keys() == {*odd_docs.columns, "words", "posteriors", "rate"}
    alone = mixing.mix(odd_docs, labelled.limit(0)).collect()
    assert all(np.allclose(list(r["posteriors"].values()), 0.25) for r in alone)
    assert mixing.mix(no_docs, labelled).count() == 0
