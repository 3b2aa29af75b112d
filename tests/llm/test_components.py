import random

from harvestlens.llm.components import components


def test_random_graphs(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000), (5, None), (None, 9000), (1003, 1003), (1003, 1003)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    rows = components(spark.createDataFrame(links, "a long, b long"))
    assert rows.count() == len(got)
    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
