import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from harvestlens.llm import secrets


def brute_spans(text):
    """Patterns as they are given, and every window's entropy anew."""
    text = text or ""
    out = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out += [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    base = list(out)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) < 20 or any(re.search(p, m[0]) for p in secrets.ALLOWED):
            continue
        joined = []
        for i in range(len(m[0]) - 19):
            w = m[0][i : i + 20]
            bits = -sum(c / 20 * math.log2(c / 20) for c in Counter(w).values())
            is_hex = re.fullmatch("[0-9a-fA-F]+", w) and re.search("[0-9]", w) and re.search("[a-fA-F]", w) and bits >= 3.0
            mixed = re.search("[0-9]", w) and re.search("[a-z]", w) and re.search("[A-Z]", w) and bits >= 3.75
            if is_hex or mixed:
                at = m.start() + i
                if joined and at <= joined[-1][1]:
                    joined[-1][1] = at + 20
                else:
                    joined.append([at, at + 20])
        out += [(s, 3, "entropy", e) for s, e in joined if not any(b[0] <= s and e <= b[3] for b in base)]
    return sorted(out)


def found(texts):
    return secrets.spans_of([(t or "").encode() for t in texts])


def test_window_sums_do_not_drift():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 60, 5)
        run = np.repeat(np.arange(5), sizes)
        codes = rng.integers(97, 97 + int(rng.integers(1, 9)), len(run)).astype(np.uint8)
        width = int(rng.integers(2, 25))
        sums = secrets.window_sums(codes, run, width)
        for i in range(len(codes)):
            first = max(i - width + 1, int(np.flatnonzero(run == run[i])[0]))
            counts = Counter(codes[first : i + 1].tolist())
            assert sums[i] == sum(round(c * math.log2(c) * 2**32) for c in counts.values())


def test_against_brute_force():
    rng = random.Random(4)
    parts = [
        'token = "', "PASSWORD:", "api_key='", "ApiKey = ", "AKIA", "ſecret=abcdefgh", "é", "漢字 ", "😀", " ", "\n", "the words of a text ", "=", "0123456789abcdef", "example",
        "550e8400-e29b-41d4-a716-446655440000", "passwd", ":", '"', ".", "/", "ABCDEFGHIJKL",
    ]
    texts = [None, ""]
    for _ in range(600):
        pick = []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.5:
                pick.append(rng.choice(parts))
            else:
                letters = rng.choice(["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "etaoin"])
                pick.append("".join(rng.choice(letters) for _ in range(rng.randint(1, 70))))
        texts.append("".join(pick))
    got = found(texts)
    assert got == [brute_spans(t) for t in texts]
    assert sum(s[2] == "entropy" for row in got for s in row) > 100


def test_kinds_and_allow_list():
    key = "q7Zt0Xb9Lw3RkV5yHc2NfJ8s"
    upper = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    kinds = [[s[2] for s in row] for row in found([f"see {key} here", f"see {upper} here", f'token = "{upper}"', "550e8400-e29b-41d4-a716-446655440000", f"{key}-EXAMPLE", "a long lowercaseconcatenationofwords", "2026010112345678901234"])]
    assert kinds == [["entropy"], ["entropy"], ["assign"], [], [], [], []]
    assert secrets.spans_of([f"{key}-EXAMPLE".encode()], allowed=()) != [[]]


def test_long_texts_stay_cheap():
    text = b"9f8E" * 250_000
    spans = secrets.spans_of([text])
    assert [s[2] for s in spans[0]] == ["entropy"] or not spans[0]
    assert found(["x" * 2_000_000 + " AKIA" + "Z" * 20]) == [[(2_000_001, 1, "access", 2_000_025)]]


def digest(spans):
    return ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in spans)


def test_rows(spark, odd_docs, no_docs):
    key = "q7Zt0Xb9Lw3RkV5yHc2NfJ8s"
    more = spark.createDataFrame([(20, f"é {key} token=abcdef"), (20, f"é {key} token=abcdef"), (None, "secret: 123456")], "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True).withColumn("spans", odd_docs["lang"])
    rows = secrets.find_secrets(docs).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append([(s["start"], s["kind"], s["end"]) for s in r["spans"]])
    want = {i: sorted([(s, kind, e) for s, _, kind, e in brute_spans(t)] for t in ts) for i, ts in texts.items()}
    assert {i: sorted(x) for i, x in got.items()} == want
    assert want[20] == [[(2, "entropy", 26), (27, "assign", 39)]] * 2
    assert secrets.find_secrets(no_docs).count() == 0


@pytest.mark.parametrize("table", ["given", "odd"])
def test_query_equals_its_sql(spark, sf, odd_docs, table, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    folder = sf
    if table == "odd":
        key = "q7Zt0Xb9Lw3RkV5yHc2NfJ8s"
        odd = [(30, f"ÄÖ api_key: '{key}{key}' {key} {'0a1b2c3d' * 4} AKIA{'Q7' * 9}"), (31, f"{key} 漢字 {key}/{key}"), (31, None), (None, "Token='a.b-c+d'")]
        folder = str(tmp_path)
        odd_docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{'/*.parquet' if table == 'odd' else ''}')")
    df = secrets.op13_secret_scan(spark, folder)
    rel = con.sql(secrets.scan_sql())
    assert sorted(df.columns) == sorted(rel.columns)
    got = Counter(tuple(r[c] for c in rel.columns) for r in df.collect())
    assert got == Counter(rel.fetchall())
    assert all(r["base_sha256"] == hashlib.sha256(",".join(s for s in r["spans"].split(",") if s and not s.startswith("entropy")).encode()).hexdigest() for r in df.collect())
