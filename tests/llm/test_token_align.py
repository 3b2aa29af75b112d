import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from harvestlens.llm import token_align


@pytest.fixture(scope="module")
def both():
    return token_align.sides()


def brute(texts, both):
    """Whole texts at once, every pair of tokens compared by their byte ranges' ends."""
    a, b = both
    out, total = [], Counter()
    for text in texts:
        links, groups, ids = [], [], ([], [])
        if text:
            ids = a.encode(text), b.encode(text)
            raw = f" {text}".encode()
            if any(b"".join(side.pieces[i] for i in own) != raw for side, own in zip(both, ids)):
                ids = [], []
        if ids[0]:
            ends = [np.cumsum([len(side.pieces[i]) for i in own]).tolist() for side, own in zip(both, ids)]
            i = j = 0
            groups.append(([], []))
            while i < len(ids[0]) or j < len(ids[1]):
                links.append((ids[0][i], ids[1][j]))
                ea, eb = ends[0][i], ends[1][j]
                if ea <= eb:
                    groups[-1][0].append(ids[0][i])
                if eb <= ea:
                    groups[-1][1].append(ids[1][j])
                i, j = i + (ea <= eb), j + (eb <= ea)
                if ea == eb and i < len(ids[0]):
                    groups.append(([], []))
        total.update(links)
        out.append((ids, groups, links))
    top = defaultdict(int)
    for (_, y), n in total.items():
        top[y] = max(top[y], n)
    rows = []
    for ids, groups, links in out:
        said = ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        rows.append((len(ids[0]), len(ids[1]), len(groups), len(links), sum(total[x] == top[x[1]] for x in links), sum(total[x] for x in links), digest))
    return rows


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a b ", "\n", "one\ntwo three", "tab\tend x", "it's we'll  'tis", "x \n y", "é漢字 😀😀 ñ", "▁ mark ▁x", "<|endoftext|> and </s> <s> <unk> <0x41>",
    "a b c", "a  b", "a\u0085 b", "\x1c x \x1d", "é ö", "﻿bom x", "nul\x00 x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "𝔘𝔫𝔦 ℂ ﷺ", "　wide　 x y", "12345 6789 0.5%", "--- === ***", "x​ y‍ z",
]


def odd_texts(n, seed=2):
    rng = random.Random(seed)
    letters = ["a", "e", "th", "ing", " ", " ", "  ", "\n", "\t", "'s", ".", "é", "漢", "😀", " ", "▁", "1", "23", "<s>", "ſ", "́", "\x85", " ", "İ", "א", "ا"]
    return [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n))]


def test_stretches_are_encoded_as_whole_texts(both):
    known, whole = token_align.Stretches(*both), token_align.Stretches(*both)
    for text in odd_texts(3000):
        if not text:
            continue
        parts = re.split(token_align.STOP, text)
        known.add([p for p in dict.fromkeys(parts) if p not in known.number])
        joined = b"".join(known.groups[known.number[p]] for p in parts)
        whole.clear()
        whole._encoded([text])
        bad = not whole.groups[0]
        assert bad == any(not known.groups[known.number[p]] for p in parts), text
        if not bad:
            assert joined == whole.groups[0], text


def test_no_piece_goes_over_a_space(both):
    assert not [p for p in both[1].pieces if b" " in p.lstrip(b" ")]


def test_shared_ends_by_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(200):
        ends, first = [[], []], [[0], [0]]
        at = 0
        for _ in range(int(rng.integers(1, 6))):
            size = int(rng.integers(1, 60))
            for k in range(2):
                inner = rng.choice(np.arange(1, size + 1), int(rng.integers(0, size)), replace=False) if size > 1 else []
                ends[k] += sorted({*(int(at + x) for x in inner), at + size})
                first[k].append(len(ends[k]))
            at += size
        got = token_align.shared_ends(*(np.array(e) for e in ends), *(np.array(f) for f in first))
        assert got.tolist() == sorted(set(ends[0]) & set(ends[1]))
    assert token_align.shared_ends(np.arange(3, 3001, 3), np.append(np.arange(2, 3000, 3), 3000), np.array([0, 1000]), np.array([0, 1000 + 0])).tolist() == [3000]


@pytest.mark.parametrize("block_bytes, kept", [(token_align.BLOCK_BYTES, token_align.KEPT_STRETCHES), (300, 40)])
def test_against_brute_force(spark, both, block_bytes, kept):
    texts = [*odd_texts(150), "the same text again", "the same text again"]
    rows = [(i if i % 11 else None, t, "x", "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, block string").repartition(3)
    got = Counter(tuple(r) for r in token_align.align(docs, block_bytes=block_bytes, kept=kept).collect())
    want = Counter((r[0], *x) for r, x in zip(rows, brute(texts, both)))
    assert got == want


def test_query(spark, sf, both):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = Counter(tuple(r) for r in token_align.op12_token_alignment(spark, sf).collect())
    assert got == Counter((d["doc_id"], *x) for d, x in zip(docs, brute([d["text"] for d in docs], both)))


def test_odd_and_empty_tables(spark, odd_docs, no_docs, both):
    docs = odd_docs.collect()
    got = Counter(tuple(r) for r in token_align.align(odd_docs).collect())
    assert got == Counter((d["doc_id"], *x) for d, x in zip(docs, brute([d["text"] for d in docs], both)))
    assert token_align.align(no_docs).count() == 0


def test_a_long_stretch_without_spaces(both):
    known = token_align.Stretches(*both)
    known.add(["ab9" * 20_000])
    counts = known.tables()[0]
    assert counts[0, 0] > 1000 and counts[0, 3] == counts[0, 0] + counts[0, 1] - counts[0, 2]


def test_documents_keep_their_stretches_and_not_their_pairs(both):
    """A block sends the pairs of each stretch once, however many documents hold it, and a document one number for each of its stretches."""
    import pyarrow as pa

    text = "unbelievable internationalisation, 12345678 notwithstanding"
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": [text, f"{text} {text}", None]})
    rows = pa.Table.from_batches(token_align._encoded(iter([batch]), token_align.TOKENIZERS, token_align.BLOCK_BYTES, token_align.KEPT_STRETCHES)).to_pylist()
    block, docs = rows[0], rows[1:]
    assert [len(d["held"]) for d in docs] == [4, 4, 0] and [d["often"] for d in docs] == [[1] * 4, [2] * 4, []]
    assert len(block["often"]) == 4 and sum(block["often"]) == len(block["held"]) == docs[0]["n_links"] > 4
    assert sum(block["times"]) == sum(d["n_links"] for d in docs)
