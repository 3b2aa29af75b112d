import numpy as np
import xxhash
from harvestlens.llm import golay, simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: {id: fingerprint}; smallest id reachable over pairs at three bits or fewer."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_every_value_is_near_one_codeword():
    values = np.random.default_rng(3).integers(0, 2**23, 5000)
    found, first = golay.near_indices(values)
    assert first.sum(axis=1).max() <= 6
    moved = values ^ (1 << np.random.default_rng(4).integers(0, 23, 5000))
    assert all(golay.decode(moved)[i] in found[i] for i in range(5000))


def test_three_bits_apart_share_a_key():
    rng = np.random.default_rng(5)
    prints = rng.integers(-(2**63), 2**63 - 1, 3000)
    for bits in range(4):
        other = prints.view(np.uint64).copy()
        for i in range(len(other)):
            for p in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(p)
        held = set(zip(*(x.tolist() for x in simhash.keys_of(prints))))
        met = {row for row, key in zip(*(x.tolist() for x in simhash.keys_of(other.view(np.int64)))) if (row, key) in held}
        assert len(met) == len(prints)


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.op6_simhash(spark, sf).collect()}
    prints = {r["doc_id"]: brute_print(r["text"]) for r in docs.collect()}
    want = brute_components(prints)
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_dense_cluster(spark):
    """Many fingerprints around one, more than a chunk holds, and a chain that leads away from it."""
    rng = np.random.default_rng(9)
    prints = {0}
    while len(prints) < 700:
        base = 0
        for p in rng.choice(20, rng.integers(0, 7), replace=False):
            base ^= 1 << int(p)
        prints.add(base)
    chain = [0b111 << 40, 0b111111 << 40, 0b111111111 << 40]
    far = [0xFFFF << 40]
    held = sorted(prints) + chain + far
    rows = spark.createDataFrame([(p,) for p in held], "fp long")
    from harvestlens.llm.components import components

    got = {r["node"]: r["root"] for r in components(simhash.links(rows)).collect()}
    want = brute_components({p: p for p in held})
    assert {p: got.get(p, p) for p in held} == want


def test_odd_rows(spark, odd_docs, no_docs):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd_docs).collect()]
    assert len(got) == 10
    by_id = {i: (f, c) for i, f, c in got}
    assert by_id[1] == by_id[2] == by_id[3] == ("0" * 16, 1)
    assert by_id[6][1] == 5 and by_id[7][1] == 7
    assert by_id[None][1] is None
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 7, 8]
    assert simhash.keep_one(no_docs).count() == 0
