"""No table whose size Spark can only guess goes through the driver: tables far under the broadcast limit are joined by shuffles as well."""

import random
import re

import pytest
from harvestlens.llm import buckets, components, mixing, passages, simhash, tiling
from harvestlens.llm.shared import stored


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sent(plans):
    """The joins that send a side through the driver."""
    return [x for p in plans for x in re.findall(r"Broadcast\w+Join.*", p)]


@pytest.fixture
def plans(monkeypatch):
    """The plans of the tables that operators write on the way."""
    found = {}

    def watch(*modules):
        for module in modules:
            kept = module.stored
            monkeypatch.setattr(module, "stored", lambda df, label, kept=kept: (found.setdefault(label, []).append(plan(df)), kept(df, label))[1])
        return found

    return watch


def texts(n=60):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(n // 2)]
    return base + [t + " end" for t in base]


def test_simhash(spark, plans):
    """Each fingerprint has over a hundred keys, so a table of them is far larger than a few bytes a row tell."""
    found = plans(buckets, components, simhash)
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    out = simhash.near_duplicates(docs)
    assert {"members", "links", "components"} <= set(found)
    assert any("SortMergeJoin" in p for p in found["members"])
    assert sent([*sum(found.values(), []), plan(out)]) == []
    assert out.count() == 60


def test_members_of_equal_buckets(spark, plans):
    found = plans(buckets)
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6), (3, 5), (4, 7), (4, 5)], "key long, item long")
    out = buckets.members(rows, "key", "item")
    assert sent([*found["members"], plan(out)]) == []
    assert sorted(map(tuple, out.collect())) == [(1, 5, 2), (1, 6, 2), (4, 5, 2), (4, 7, 2)]


def test_repeated_paragraphs_and_passages(spark, plans):
    """The parts of a bucket are as many rows as its members times its chunks, after an explode."""
    found = plans(buckets, components, passages)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    shared = [" ".join(rng.choices(words, k=60)) for _ in range(3)]
    docs = [(i, "\n".join([" ".join(rng.choices(words, k=40)), shared[i % 3], " ".join(rng.choices(words, k=9)) + " " + shared[(i + 1) % 3] + " end"])) for i in range(30)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    out = passages.cleaned(rows)
    narrow = [p for label in ("members", "colliding", "links", "marks", "gone", "spans") for p in found[label]]
    assert sent(narrow) == []
    held = spark.createDataFrame([(i, (i, 0), 1, *[7] * passages.BANDS) for i in range(4)], passages.paragraph_classes(passages.paragraphs(rows)).schema)
    assert sent([plan(passages.links(rows, held))]) == []
    assert sum(1 for r in out.collect() if r["removed"]) >= 27


def test_runs_and_items(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(5)]
    docs = [(i, " ".join(rng.choices(words, k=30)) + " " + items[i % 5][1]) for i in range(20)]
    out = tiling.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [x for x in sent([plan(out)]) if re.search(r"Join \[(run|seed)#", x)] == []
    assert sorted((r["doc_id"], r["item_id"]) for r in out.collect()) == [(i, i % 5) for i in range(20)]


def test_labelled_languages(spark):
    docs = spark.createDataFrame([(1, "en"), (2, "de"), (3, None)], "doc_id long, lang string")
    labels = stored(spark.createDataFrame([(1,), (1,), (3,), (None,)], "doc_id long"), "labels")
    out = mixing.labelled_languages(docs, labels)
    assert sent([plan(out)]) == []
    assert sorted(map(tuple, out.collect())) == [(1, "en"), (3, None)]
