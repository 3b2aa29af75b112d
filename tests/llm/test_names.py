"""Documents whose columns are called what the operators call theirs: every quoted name in their code is an extra column."""

import re
from pathlib import Path

import pytest
from harvestlens import llm
from harvestlens.llm import byte_cnn, license_scan, mixing, passages, secrets, simhash, spelling, tiling, token_align
from pyspark.sql import functions as F

GIVEN = {"doc_id", "text", "lang", "n_chars"}
OTHERS = ["Lines", "a.b", "with `tick", "__own_0", "__own_1"]


@pytest.fixture(scope="module")
def named(spark, sf):
    folder = Path(llm.__file__).parent
    found = {n for f in folder.glob("*.py") for n in re.findall(r"[\"'](_*[a-z][a-z0-9_]*)[\"']", f.read_text())}
    assert {"lines", "a", "_id", "share", "_bytes", "_spans"} <= found
    # the documents' own columns keep their names
    names = [*sorted(found - GIVEN - {n.lower() for n in OTHERS}), *OTHERS]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "n_chars").filter("doc_id < 60")
    return docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names if n != "lines"]), names


def plain(docs):
    return docs.select("doc_id", "text", "lang", "n_chars")


STAGES = {
    "op2": lambda docs, spark, sf: passages.keep_rest(docs),
    "op3": lambda docs, spark, sf: tiling.without_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")),
    "op6": lambda docs, spark, sf: simhash.keep_one(docs),
    "op7": lambda docs, spark, sf: mixing.mix(docs, mixing.labelled_languages(docs, spark.read.parquet(f"{sf}/labels.parquet"))),
    "op10": lambda docs, spark, sf: byte_cnn.keep_good(docs, spark.read.parquet(f"{sf}/labels.parquet")),
}
MADE = {"op7": {"words", "posteriors", "rate"}}


@pytest.mark.parametrize("stage", STAGES)
def test_stages_keep_columns_of_any_name(spark, sf, named, stage):
    docs, names = named
    out = STAGES[stage](docs, spark, sf)
    made = MADE.get(stage, set())
    assert set(out.columns) == set(docs.columns) | made
    rows = out.collect()
    want = {r["doc_id"]: r["text"] for r in STAGES[stage](plain(docs), spark, sf).collect()}
    assert {r["doc_id"]: r["text"] for r in rows} == want and len(rows) > 20
    for r in rows:
        kept = [n for n in docs.columns if n not in GIVEN | made]
        assert all(r[n] == f"{n}{r['doc_id']}" for n in kept)


@pytest.mark.parametrize("scan", [license_scan.scan, secrets.find_secrets, token_align.align, spelling.variants, simhash.near_duplicates, passages.cleaned], ids=lambda f: f.__name__)
def test_scans_do_not_read_them(named, scan):
    docs, _ = named
    columns = [c for c in scan(plain(docs)).columns if c not in docs.columns or c in ("doc_id", "text")]
    key = "word" if scan is spelling.variants else "doc_id"
    shown = [key, *[c for c in columns if c != key]]
    def rows(df):
        return sorted(map(str, scan(df).select(shown).collect()))

    assert rows(docs) == rows(plain(docs))
