import random

import numpy as np
from harvestlens.llm import tiling


def brute_tiles(doc, item, least):
    """Greedy string tiling as published: all longest free matches of each round, until none is long enough."""
    in_doc, in_item, sizes = set(), set(), []
    while True:
        best = (least - 1, None, None)
        for d in range(len(doc)):
            for i in range(len(item)):
                k = 0
                while d + k < len(doc) and i + k < len(item) and doc[d + k] == item[i + k] and d + k not in in_doc and i + k not in in_item:
                    k += 1
                if k > best[0]:
                    best = (k, d, i)
        if best[1] is None:
            return sizes
        k, d, i = best
        in_doc.update(range(d, d + k))
        in_item.update(range(i, i + k))
        sizes.append(k)


def test_tiles_against_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        item = [rng.randrange(40) for _ in range(30)]
        cut = sorted(rng.sample(range(31), 3))
        doc = item[cut[1] : cut[2]] + [99] + item[: cut[0]] + [rng.randrange(40) for _ in range(10)] + item[cut[0] : cut[1]]
        places = [(d, i) for d in range(len(doc) - 2) for i in range(len(item) - 2) if doc[d : d + 3] == item[i : i + 3]]
        got = tiling.tiles(np.array(places), 3) if places else []
        assert sorted(t[2] for t in got) == sorted(brute_tiles(doc, item, 3))
        for d, i, n in got:
            assert doc[d : d + n] == item[i : i + n]


def test_reordered_edited_and_clean(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(5000)]
    item = rng.sample(words, 40)
    other = [w for w in words if w not in item]
    pad = lambda n: rng.sample(other, n)
    docs = [
        (1, " ".join(pad(50) + item + pad(50))),
        (2, " ".join(pad(10) + item[20:] + pad(10) + item[:20])),
        (3, " ".join(pad(30) + item[:12] + pad(30))),
        (4, " ".join(pad(80))),
        (5, ", ".join(w.upper() for w in item) + "."),
        (6, " ".join(" ".join(item[i : i + 4]) + " gap" for i in range(0, 40, 4))),
        (1, " ".join(pad(5))),
        (None, " ".join(item)), (7, None), (8, ""),
    ]
    bench = [(70, " ".join(item)), (71, " ".join(item)), (72, "too short"), (73, None), (None, " ".join(pad(20)))]
    got = tiling.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    rows = {(r["doc_id"], r["item_id"]): r for r in got.collect()}
    assert set(rows) == {(d, i) for d in (1, 2, 5) for i in (70, 71)}
    assert rows[1, 70]["covered"] == rows[2, 70]["covered"] == 40 and rows[2, 70]["n_tiles"] == 2 and rows[1, 70]["longest"] == 40


def test_whole_table_against_brute_force(spark, sf):
    import re

    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = {r["item_id"]: split(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        doc = split(r["text"])
        runs = {tuple(doc[k : k + 5]) for k in range(len(doc) - 4)}
        for i, item in items.items():
            if any(tuple(item[k : k + 5]) in runs for k in range(len(item) - 4)):
                covered = sum(brute_tiles(doc, item, 5))
                if covered >= 0.5 * len(item):
                    want[r["doc_id"], i] = covered
    assert {(r["doc_id"], r["item_id"]): r["covered"] for r in tiling.op3_decontaminate(spark, sf).collect()} == want and want


def test_odd_rows(spark, odd_docs, no_docs, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert tiling.leaks(odd_docs, bench).count() == 0
    assert tiling.leaks(no_docs, bench).count() == tiling.leaks(odd_docs, bench.limit(0)).count() == 0
    kept = tiling.without_leaks(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == 10
