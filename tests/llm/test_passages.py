import random
import re

from harvestlens.llm import passages


def words_of(line):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))


def brute(docs, similarity=passages.SIMILARITY, least=passages.MIN_WORDS):
    """docs: (doc_id, text); the text of each without its repeated paragraphs."""
    place, grams = [], []
    for i, text in docs:
        for n, line in enumerate((text or "").split("\n")):
            w = words_of(line)
            if len(w) >= least:
                place.append((i, n))
                grams.append((tuple(w), {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    root = list(range(len(place)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(place)):
        for b in range(a):
            shared = len(grams[a][1] & grams[b][1])
            if grams[a][0] == grams[b][0] or shared >= similarity * len(grams[a][1] | grams[b][1]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for k in range(len(place)):
        groups.setdefault(find(k), []).append(place[k])
    gone = {p for g in groups.values() for p in g if p != min(g)}
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if (i, n) not in gone) for i, t in docs}


def test_tuning_reaches_its_recall():
    bands, rows = passages.tuned()
    assert 1 - (1 - passages.SIMILARITY**rows) ** bands >= passages.RECALL


def test_planted_passages(spark):
    rng = random.Random(3)
    words = [f"w{i}x" for i in range(4000)]
    para = lambda n: rng.sample(words, n)
    shared = para(60)
    docs = []
    for i in range(40):
        lines = [para(rng.randrange(3, 70)) for _ in range(4)]
        if i % 3 == 0:
            lines.insert(rng.randrange(4), shared)
        if i % 5 == 0:
            edited = list(shared)
            edited[rng.randrange(60)] = "other"
            lines.append(edited)
        docs.append((i, "\n".join(" ".join(x) for x in lines)))
    docs += [(100, "Short line."), (101, "Short line."), (102, "\n".join([" ".join(shared).upper()] * 2))]
    rng.shuffle(docs)
    rows = passages.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == brute(docs) and not any(r["cuts"] for r in rows)


def test_passages_spliced_into_other_text(spark):
    """Cut wherever they stand, from all but the first document; shorter ones stay, and what surrounds them stays whole."""
    rng = random.Random(12)
    words = [f"v{i}y" for i in range(30000)]
    passage, short, long = rng.sample(words, 51), rng.sample(words, 45), rng.sample(words, 120)
    docs, want = [], {}
    for i in range(30):
        before, after = rng.sample(words, rng.randrange(40, 90)), rng.sample(words, rng.randrange(40, 90))
        middle = {0: passage, 1: long, 2: short}[i % 3]
        text = " ".join(middle)
        if i % 2:
            text = text.replace(middle[20] + " ", middle[20] + ".\n", 1).title()
        docs.append((i, " ".join(before) + " " + text + ", " + " ".join(after)))
        want[i] = docs[-1][1] if i < 3 or i % 3 == 2 else " ".join(before) + " " + " ".join(after)
    rng.shuffle(docs)
    rows = {r["doc_id"]: r for r in passages.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: r["text"] for i, r in rows.items()} == want
    # a mark that reaches the passage's end may be found in a later document first
    assert all(r["cuts"] == (0 if i < 3 or i % 3 == 2 else 1) and (r["keepers"][:1] == [i % 3] if r["cuts"] else r["keepers"] == []) for i, r in rows.items())


def check_cut_from_later(spark, docs, want):
    rows = {r["doc_id"]: r for r in passages.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: r["text"] for i, r in rows.items()} == want
    check_against_brute_force(docs, rows.values())


def test_passages_of_which_an_earlier_document_holds_a_part(spark):
    """Two documents share a passage; the first holder of its marks holds 40 of its 51 words, and another document another part."""
    rng = random.Random(21)
    words = [f"u{i}z" for i in range(60000)]
    docs, want = [], {}
    for k in range(12):
        passage = rng.sample(words, 51)
        at = rng.randrange(12)
        for n, middle in enumerate((passage[at : at + 40], passage[11:], passage, passage)):
            before, after = rng.sample(words, rng.randrange(30, 60)), rng.sample(words, rng.randrange(30, 60))
            docs.append((10 * k + n, " ".join([*before, *middle, *after])))
            want[10 * k + n] = docs[-1][1] if n < 3 else " ".join(before + after)
    rng.shuffle(docs)
    check_cut_from_later(spark, docs, want)


def test_passages_whose_words_return(spark):
    """A passage of few words over and over; other documents hold more rounds of it than the first."""
    rng = random.Random(22)
    words = [f"t{i}s" for i in range(60000)]
    docs, want = [], {}
    for k, period in enumerate((1, 2, 7, 12, 20, 30, 37)):
        round_ = rng.sample(words, period)
        for n, rounds in enumerate((51 + period, 300, 301)):
            middle = (round_ * 301)[n : n + rounds]
            before, after = rng.sample(words, 40), rng.sample(words, 40)
            docs.append((10 * k + n, " ".join([*before, *middle, *after])))
            want[10 * k + n] = docs[-1][1] if n == 0 else " ".join(before + after)
    check_cut_from_later(spark, docs, want)


def test_cut():
    text = b"one two, three four. Five\nsix seven\neight"
    assert passages.cut(text, [], [(1, 3), (2, 4)], 3) == (b"one Five\nsix seven\neight", 1)
    assert passages.cut(text, [], [(1, 3)], 3) == (text, 0)
    assert passages.cut(text, [1], [], 3)[0] == b"one two, three four. Five\neight"
    assert passages.cut(text, [1, 2], [], 3)[0] == b"one two, three four. Five"
    assert passages.cut(text, [0, 1, 2], [], 3)[0] == b""
    assert passages.cut(text, [0], [(5, 8)], 3) == (b"", 1)
    assert passages.cut(text, [2], [(0, 3)], 3)[0] == b"four. Five\nsix seven"


def test_many_near_copies(spark):
    """More variants of one paragraph than a chunk holds."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(80)]
    docs = []
    for i in range(900):
        own = list(base)
        own[rng.randrange(80)] = f"edit{i}"
        docs.append((i, " ".join(own)))
    docs.append((900, " ".join(f"c{i}" for i in range(80))))
    rows = passages.cleaned(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in rows if r["text"]) == [0, 900]
    assert all(r["keepers"] == [0] for r in rows if r["removed"])


def check_against_brute_force(docs, rows):
    """Paragraphs as brute force removes them; of what is left, runs that an earlier document holds are cut, and they alone."""
    texts, n = dict(docs), passages.PASSAGE_WORDS
    pieces = {}
    for r in rows:
        own, now = [], []
        for k, line in enumerate((texts[r["doc_id"]] or "").split("\n")):
            if k in r["removed"]:
                own.append(now)
                now = []
            else:
                now += words_of(line)
        pieces[r["doc_id"]] = [*own, now]
    left = brute(docs)
    first = {}
    for i in sorted(pieces):
        assert words_of(left[i].replace("\n", " ")) == sum(pieces[i], [])
        for w in pieces[i]:
            for k in range(len(w) - n + 1):
                first.setdefault(tuple(w[k : k + n]), i)
    for r in rows:
        want = []
        for w in pieces[r["doc_id"]]:
            covered = [False] * len(w)
            for k in range(len(w) - n + 1):
                if first[tuple(w[k : k + n])] < r["doc_id"]:
                    covered[k : k + n] = [True] * n
            want += [x for x, c in zip(w, covered) if not c]
        assert words_of((r["text"] or "").replace("\n", " ")) == want, r["doc_id"]


def test_whole_table_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_against_brute_force(docs, passages.op2_substring_dedup(spark, sf).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    rows = passages.cleaned(odd_docs).collect()
    assert len(rows) == 10
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[2]["text"] is None and by_id[1]["text"] == "" and by_id[2]["removed"] == []
    assert by_id[5]["removed"] == [] and by_id[6]["removed"] == [0] and by_id[6]["text"] == "" and by_id[6]["keepers"] == [5]
    assert by_id[None]["removed"] == []
    kept = passages.keep_rest(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 9
    assert passages.cleaned(no_docs).count() == passages.keep_rest(no_docs).count() == 0
