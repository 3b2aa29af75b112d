import corpus_pipeline as pipeline
import pytest
from harvestlens.llm import byte_cnn, mixing, passages, queries, simhash, tiling
from harvestlens.llm.shared import stored

from tests.llm.test_passages import check_against_brute_force
from tests.llm.test_simhash import brute_components, brute_print


def test_stages_and_queries():
    assert [f.__name__ for _, f in pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "mixing_to_targets"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_each_stage_on_what_the_one_before_kept(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, sf), "stage")
        rows, was = docs.collect(), before.collect()
        kept[stage.__name__] = len(rows)
        if stage is pipeline.mixing_to_targets:
            assert set(docs.columns) == {*columns, "words", "posteriors", "rate"} and len(rows) == len(was)
            continue
        assert docs.columns == columns
        ids = {r["doc_id"] for r in rows}
        if stage is pipeline.quality_classifier:
            assert ids == {r["doc_id"] for r in byte_cnn.score_documents(before, labels).collect() if r["predicted"] == 1}
        elif stage is pipeline.simhash_near_dedup:
            root = brute_components({r["doc_id"]: brute_print(r["text"]) for r in was})
            assert ids == set(root.values())
        elif stage is pipeline.substring_dedup:
            left = passages.cleaned(before).collect()
            check_against_brute_force([(r["doc_id"], r["text"]) for r in was], left)
            same = {r["doc_id"] for r in left if not r["removed"] and not r["cuts"]}
            assert {r["doc_id"]: r["text"] for r in rows} == {r["doc_id"]: r["text"] for r in left if r["text"].strip() or r["doc_id"] in same}
        else:
            assert ids == {r["doc_id"] for r in was} - {r["doc_id"] for r in tiling.leaks(before, bench).collect()}
    assert kept["simhash_near_dedup"] < kept["quality_classifier"] and kept["mixing_to_targets"] > 100
    assert pipeline.run(spark, sf).count() == kept["mixing_to_targets"]


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES], ids=lambda f: f.__name__)
def test_stages_on_odd_rows(spark, stage, odd_docs, no_docs, sf):
    out = stage(spark, odd_docs, sf)
    assert set(odd_docs.columns) <= set(out.columns)
    out.collect()
    assert stage(spark, no_docs, sf).count() == 0
