import hashlib

import pytest
from harvestlens.llm import chat
from hypothesis import given, settings, strategies as st


def brute(turns):
    """turns: (role, text) in order."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    learned = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(learned), sha(learned)


pieces = st.lists(st.sampled_from(["\\", "<", "<turn>", "</turn>", "<text>", "\\<", "<|image 0|>", "### Assistant:", "\n", "a", "é", "😀", "\\\\"]) | st.characters(exclude_categories=["Cs"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(pieces, pieces)
def test_any_text_reads_back(role, text):
    written = chat.TURN + chat.escaped(role) + chat.TEXT + chat.escaped(text) + chat.END
    assert chat.read_turn(written) == (role, text)


def test_whole_table_against_brute_force(spark, sf):
    held = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        held.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    held[-7] = [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.op8_chat_format(spark, sf).collect()}
    assert got == {c: brute(t) for c, t in held.items()}


def test_typed_parts(spark):
    part = lambda kind, **x: (kind, x.get("text"), x.get("ref"), x.get("width"), x.get("height"), x.get("seconds"), x.get("pages"))
    parts = [
        part("text", text="see "), part("image", ref="img://1", width=900, height=448), part(None, text="<|image 9|> and"), part("audio", ref="a.wav", seconds=2.5), part("document", ref=None, pages=3),
        part("unknown", text="two words"), None,
    ]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, None, None)], f"conv_id long, turn long, role string, parts {chat.PART_TYPE}")
    rows = {r["turn"]: r for r in chat.format_turns(df).collect()}
    r = rows[0]
    assert r["formatted"] == "<turn>assistant<text>see <|image 0|>\\<|image 9|> and<|audio 1|><|document 2|>two words</turn>"
    assert [(a["place"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "img://1", 3 * 256), (1, "audio", "a.wav", 63), (2, "document", None, 1800)]
    assert r["tokens"] == 1 + 768 + 3 + 63 + 1800 + 2
    assert "".join(chat.unescaped(r["formatted"][s["start"] : s["stop"]]) for s in r["loss"]) == "see <|image 9|> andtwo words"
    assert rows[1]["formatted"] == "<turn><text></turn>" and rows[1]["loss"] == []
    assert chat.read_turn(r["formatted"])[1] == "see <|image 9|> andtwo words"


def test_odd_rows(spark):
    rows = [(1, 2, "user", None), (1, None, None, "x"), (1, 2, "user", None), (None, 0, "assistant", "n"), (0, 0, "assistant", "z" * 300000), (1, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.format_turns(chat.text_parts(df))).collect()}
    assert got == {1: brute([(None, "x"), ("assistant", ""), ("user", None), ("user", None)]), None: brute([("assistant", "n")]), 0: brute([("assistant", "z" * 300000)])}
    assert chat.digests(chat.format_turns(chat.text_parts(df.limit(0)))).count() == 0


@pytest.mark.parametrize("odd", [False, True])
def test_query_equals_its_sql(spark, sf, odd, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    folder, glob = sf, ""
    if odd:
        folder, glob = str(tmp_path), "/*.parquet"
        rows = [(1, 0, "user", None), (1, None, "assistant", "\\<é漢😀</turn>"), (1, 1, "assistant", ""), (1, 1, "assistant", "again"), (None, 0, None, "no id"), (2, 5, "tool<x>", "<|image 0|>\\\\<")]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet{glob}')")
    rel = con.sql(chat.digests_sql())
    df = chat.op8_chat_format(spark, folder)
    assert sorted(df.columns) == sorted(rel.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=key) == sorted(rel.fetchall(), key=key)
