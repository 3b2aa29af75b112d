import numpy as np
import pytest
from harvestlens.llm import caps


def brute(ids, vectors, cosine=caps.COSINE):
    unit = caps.unit_rows(np.array(vectors))
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    label = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(near)):
            low = min(label[ids[a]], label[ids[b]])
            if label[ids[a]] != low or label[ids[b]] != low:
                label[ids[a]] = label[ids[b]] = low
                changed = True
    return {i: (int(near[k].sum()), label[i]) for k, i in enumerate(ids)}


def around(rng, size, n, spread):
    base = rng.normal(size=size)
    return [base + spread * np.linalg.norm(base) / np.sqrt(size) * rng.normal(size=size) for _ in range(n)]


@pytest.mark.parametrize("size", [2, 5, 12, 64])
def test_against_brute_force(spark, size):
    rng = np.random.default_rng(size)
    vectors = [rng.normal(size=size) for _ in range(60)]
    for _ in range(6):
        vectors += around(rng, size, 6, 0.1)
    vectors += [vectors[0]] * 5 + [vectors[61]] * 3 + [3 * vectors[1]]
    ids = [int(i) for i in rng.permutation(len(vectors))]
    got = caps.near_duplicates(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")).collect()
    want = brute(ids, vectors)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_cluster_over_several_chunks_counts_each_link_once(spark):
    """Every pair that shares a filter counts once, however many filters and parts it meets in."""
    rng = np.random.default_rng(2)
    vectors = around(rng, 64, 1300, 0.2) + [rng.normal(size=64) for _ in range(50)]
    unit = caps.unit_rows(np.array(vectors))
    row, key = caps.filters(unit)
    member = np.zeros((len(unit), len(np.unique(key))), np.float32)
    member[row, np.unique(key, return_inverse=True)[1]] = 1
    found = (unit @ unit.T >= caps.COSINE) & (member @ member.T > 0)
    np.fill_diagonal(found, False)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in caps.near_duplicates(df).collect()}
    want = brute(list(range(len(vectors))), vectors)
    assert {i: n for i, (n, _) in got.items()} == dict(enumerate(found.sum(axis=1).tolist()))
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}
    assert found.sum() >= 0.999 * sum(n for n, _ in want.values())


def test_recall_at_the_threshold():
    """Pairs at a cosine of 0.9 or little more share a filter; the target is nine in ten."""
    rng = np.random.default_rng(6)
    for size in (2, 5, 8, 16, 24, 64, 256):
        a = caps.unit_rows(rng.normal(size=(1500, size)))
        away = rng.normal(size=a.shape)
        away = caps.unit_rows(away - (away * a).sum(axis=1, keepdims=True) * a)
        b = 0.9 * a + np.sqrt(1 - 0.81) * away
        held = set(zip(*(x.tolist() for x in caps.filters(a))))
        met = {r for r, k in zip(*(x.tolist() for x in caps.filters(b))) if (r, k) in held}
        assert len(met) >= 0.97 * len(a), size


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 0.0], 0), (8, [1.0, 0.0], 1), (8, [1.0, 0.0], 1),
        (9, [1e300, 1e299], 0), (10, [1.0, 0.0, 0.0], 0), (11, [-1.0, 0.0], 0), (None, [1.0, 0.0], 0), (12, [1e-300, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in caps.near_duplicates(df).collect()), key=str)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 11)] + [(7, 4, 7, True), (8, 4, 7, False), (8, 4, 7, False), (9, 4, 7, False), (12, 4, 7, False), (None, 0, None, None)]
    assert got == sorted(want, key=str)
    assert caps.near_duplicates(df.limit(0)).count() == 0
