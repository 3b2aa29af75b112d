import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from harvestlens.llm import spelling

LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def one_edit(x, y):
    if abs(len(x) - len(y)) > 1 or x == y:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(rows):
    """rows: (doc_id, text); all words, every two of them compared."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    by_hole = {}
    for w in n:
        for key in {(i, len(w), w[:i] + w[i + 1 :]) for i in range(len(w))}:
            by_hole.setdefault(("same", *key), []).append(w)
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_hole.setdefault(("cut", key), []).append(w)
    near = {w: set() for w in n}
    for key, held in by_hole.items():
        for x in held:
            near[x] |= {y for y in held if one_edit(x, y)}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda y: (-n[y], y))
            if n[best] >= 2 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def variants(df, **how):
    return sorted(tuple(r) for r in spelling.variants(df, **how).collect())


def spelled(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeÀéÿ×") for _ in range(rng.randint(4, 9))) for _ in range(12)]
    words = []
    for _ in range(n):
        w = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i, kind = rng.randrange(len(w) + 1), rng.random()
            if kind < 0.4:
                w.insert(i, rng.choice("abcdeÉ"))
            elif w and kind < 0.7:
                w.pop(min(i, len(w) - 1))
            elif w:
                w[min(i, len(w) - 1)] = rng.choice("abcde")
        words.append("".join(w))
    return words


@pytest.mark.parametrize("how", [{}, {"cell": 20, "asking": 15}, {"cell": 20, "asking": 15, "sample": 30}])
def test_against_brute_force(spark, how):
    rng = random.Random(8)
    words = [w.upper().translate(LOW) if rng.random() < 0.1 else w for w in spelled(5, 6000)]
    rows = [(i if i % 7 else None, " ".join(words[i * 60 : i * 60 + 60]), "x", "y") for i in range(100)] + [(500, None, "x", "y"), (501, "", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n string")
    want = brute([r[:2] for r in rows])
    assert variants(df, **how) == want
    assert sum(r[1] is not None for r in want) > 50


def test_search_by_enumeration():
    for seed in range(6):
        words = sorted(set(spelled(seed, 1500)))
        for size in range(5, 9):
            points = [w for w in words if len(w) == size]
            for longer in (False, True):
                asking = [w for w in words if len(w) == size - longer]
                codes = [[w.encode("latin-1") for w in x] for x in (points, asking)]
                got = sorted(zip(*(x.tolist() for x in spelling.near_in(*codes, longer))))
                assert got == [(i, j) for i, a in enumerate(asking) for j, p in enumerate(points) if one_edit(a, p)]


def test_boxes_meet_every_leaf_in_reach():
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.8, (800, spelling.LETTERS)).astype(np.int32)
    tree = spelling.fitted(counts[:300], 10)
    leaf = tree.leaf_of(counts)
    met = set(zip(*(x.tolist() for x in tree.met(counts, 1, 1))))
    assert all((i, k) in met for i, k in enumerate(leaf.tolist()))
    moved = counts.copy()
    for i in range(len(moved)):
        down, up = rng.choice(np.flatnonzero(moved[i])), rng.integers(spelling.LETTERS)
        moved[i, down] -= 1
        moved[i, up] += 1
    assert all((i, k) in met for i, k in enumerate(tree.leaf_of(moved).tolist()))
    assert len(met) < len(counts) * tree.leaves / 2


def test_chains_end_at_their_roots(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(45)] + [("x", "w010"), ("y", "z")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "z" if w == "y" else "w045" for w, _ in chain}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def test_equal_letter_counts_and_long_words(spark):
    rng = random.Random(1)
    anagrams = ["".join(rng.sample("aabbccddee", 10)) for _ in range(300)] + ["".join(rng.sample("aabbccddef", 10)) for _ in range(300)]
    long = ["q" * 3000, "q" * 3001, "q" * 1500 + "r" + "q" * 1500]
    rows = [(i, " ".join([*anagrams, *long])) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert variants(df, cell=100, asking=150) == brute(rows)


def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in spelling.op11_spelling_variants(spark, sf).collect()) == brute(docs)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    assert variants(odd_docs) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert variants(no_docs) == []


def test_a_cell_fits_its_tree_once(monkeypatch):
    import pyarrow as pa

    fits = []
    monkeypatch.setattr(spelling, "fitted", lambda counts, most, fitted=spelling.fitted: fits.append(len(counts)) or fitted(counts, most))
    words = [("river", 0), ("rivet", 0), ("river", 1), ("rivet", 1), ("rive", 2), ("rivr", 2)]
    batch = pa.table({"cell": [5] * 6, "p": [0] * 6, "q": [0] * 6, "kind": [k for _, k in words], "word": [w for w, _ in words], "n": [3] * 6}).to_batches()[0]
    got = [tuple(r.values())[:2] for out in spelling._near(iter([batch])) for r in out.to_pylist()]
    assert fits == [2]
    assert sorted(got) == sorted([("river", "rivet"), ("rivet", "river"), ("rive", "river"), ("rive", "rivet"), ("river", "rive"), ("rivet", "rive"), ("rivr", "river"), ("river", "rivr")])


def test_marks_never_lack_more_than_the_counts():
    rng = np.random.default_rng(4)
    x, y = (rng.poisson(0.6, (3000, spelling.LETTERS)).astype(np.int32) for _ in range(2))
    y[:1500] = x[:1500]
    y[np.arange(1500), rng.integers(0, spelling.LETTERS, 1500)] += 1
    found = spelling.lacking(spelling.marks(x), spelling.marks(y))
    assert (found <= np.maximum(x - y, 0).sum(axis=1)).all() and (found[1500:] > 0).all()


def test_only_letters_a_to_z_are_lowered(spark):
    rows = [(i, "ÀPFEL Äpfel äPFEL apfel ABcDe fünfÉ ab abcd xÿZZZ9QQQQQ") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert variants(df) == brute(rows)
