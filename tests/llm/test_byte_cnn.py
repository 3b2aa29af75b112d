import zlib

import numpy as np
from harvestlens.llm import byte_cnn


def test_scores_against_the_definition():
    """A score by loops over chunks, windows and filters, and no influence of the texts beside it."""
    rng = np.random.default_rng(2)
    net = byte_cnn.Network(rng.normal(size=(256, 4)), rng.normal(size=(6, 4, byte_cnn.FILTERS)), rng.normal(size=byte_cnn.FILTERS), rng.normal(size=3 * byte_cnn.FILTERS), 0.3)
    net.embedding[0] = 0
    texts = [b"", b"abc", bytes(rng.integers(1, 256, 700).astype(np.uint8)), b"x" * 122, b"y" * 123]
    got = byte_cnn.Scorer(net).scores(texts)

    def slow(text):
        if not text:
            return 1 / (1 + np.exp(-net.offset))
        raw = np.zeros(-(-(len(text) + 6) // 128) * 128 + 128, np.uint8)
        raw[6 : 6 + len(text)] = np.frombuffer(text, np.uint8)
        segments = []
        for s in range(len(raw) // 128 - 1):
            acts = [sum(net.embedding[raw[p + k]] @ net.filters[k] for k in range(6)) for p in range(s * 128, s * 128 + 128, 2)]
            segments.append(np.max(acts, axis=0) + net.bias)
        chunks = [np.maximum(a, b) for a, b in zip(segments, segments[1:])] or segments
        top = np.maximum(chunks, 0)
        x = np.concatenate((top.mean(axis=0), top.max(axis=0), top.min(axis=0)))
        return 1 / (1 + np.exp(-np.clip(x @ net.weight + net.offset, -40, 40)))

    assert np.allclose(got, [slow(t) for t in texts], atol=1e-5)
    assert np.allclose(byte_cnn.Scorer(net).scores(texts[2:3]), got[2:3])


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    net = byte_cnn.Network(rng.normal(size=(256, 4)), 0.3 * rng.normal(size=(6, 4, byte_cnn.FILTERS)), np.zeros(byte_cnn.FILTERS), 0.3 * rng.normal(size=3 * byte_cnn.FILTERS), 0.1)
    net.embedding[0] = 0
    texts, marks, weights = [b"some plain words in a row " * 9, b"#### $$$ ###" * 20], np.array([1, 0]), np.array([1.0, 1.0])

    def loss():
        s = np.clip(byte_cnn.Scorer(net).scores(texts), 1e-9, 1 - 1e-9)
        return float(-(weights * (marks * np.log(s) + (1 - marks) * np.log(1 - s))).mean())

    slopes = byte_cnn._gradients(net, texts, marks, weights)
    for value, slope in ((net.filters, slopes[1]), (net.weight, slopes[3]), (net.bias, slopes[2])):
        spot = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        old = value[spot]
        value[spot] = old + 1e-3
        up = loss()
        value[spot] = old - 1e-3
        down = loss()
        value[spot] = old
        assert np.isclose((up - down) / 2e-3, slope[spot], rtol=0.1, atol=2e-3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in byte_cnn.op10_quality(spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    marks = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(r["score"], q) for r, q in marks if r["held_out"]]
    assert np.mean([(s >= 0.3) == (q == 1) for s, q in held]) >= 0.9
    assert all(s >= 0.3 for s, q in held if q == 1)


def test_odd_rows(spark, odd_docs, no_docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    odd_labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, None), (7, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int"))
    docs = odd_docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"), allowMissingColumns=True)
    rows = byte_cnn.score_documents(docs, odd_labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    empty = {r["score"] for r in rows if not r["text"]}
    assert len(empty) == 1 and all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert byte_cnn.score_documents(no_docs, labels).count() == 0
    alone = byte_cnn.score_documents(odd_docs, labels.limit(0)).collect()
    assert {r["score"] for r in alone} == {0.5}
    assert byte_cnn.keep_good(odd_docs, labels.limit(0)).columns == odd_docs.columns
