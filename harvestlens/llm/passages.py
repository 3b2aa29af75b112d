"""Substring dedup: paragraphs that repeat across documents, by MinHash banding.

A paragraph is a line of a text. Equal paragraphs are one class from the start. Classes whose MinHash bands collide meet in buckets, where the exact
Jaccard similarity of their word shingles decides; the components of these links are groups of which one paragraph, in the document with the smallest id,
stays. Bands and rows are tuned for recall at the similarity asked for.

A passage that is spliced into other text fills no paragraph. So in what the paragraphs leave, the hashes of word runs are thinned to the smallest of each
window of neighbours (winnowing): two texts that share PASSAGE_WORDS words or more share such a mark, whatever stands around. Around marks that
meet, all runs of PASSAGE_WORDS words are compared by hash: the first document that holds a run keeps it, and it is cut from the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from harvestlens.llm.buckets import bucket_order, chunked, forest, members
from harvestlens.llm.components import components
from harvestlens.llm.shared import by_shuffle, groups, in_small_batches, set_aside, stored, table, text_blocks
from harvestlens.llm.words import LOWER, edges, mixed, runs, split_words

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.995
# A paragraph of fewer words is no passage: short lines repeat by chance and stay.
MIN_WORDS = 25
# Shared runs of over 50 words are cut, wherever they stand; a mark is a run of MARK_WORDS words, the smallest by hash of WINDOW neighbours.
PASSAGE_WORDS, MARK_WORDS = 51, 14
WINDOW = PASSAGE_WORDS - MARK_WORDS + 1


def tuned(similarity: float = SIMILARITY, recall: float = RECALL, low: float = 0.2, stray: float = 0.02) -> tuple[int, int]:
    """(bands, rows): the fewest hash functions whose bands find a pair at `similarity` with probability `recall` at least, while a pair at
    `low` similarity collides with probability `stray` at most."""
    fits = []
    for rows in range(1, 13):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(similarity**rows))))
        if 1 - (1 - low**rows) ** bands <= stray:
            fits.append((bands * rows, bands, rows))
    return min(fits)[1:]


BANDS, ROWS = tuned()
_RNG = np.random.default_rng(77)
_MULTIPLY = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = _RNG.integers(0, 2**63, BANDS, dtype=np.uint64)


def _shingles(hashes: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, line): hashes of the word shingles that stand within a line."""
    all_runs = runs(hashes, SHINGLE)
    inside = line[: len(all_runs)] == line[SHINGLE - 1 :] if len(all_runs) else np.zeros(0, bool)
    return all_runs[inside], line[: len(all_runs)][inside]


def _content(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the words of each line that holds some; starts: where each line's words begin."""
    size = np.diff(np.append(starts, len(hashes)))
    place = (np.arange(len(hashes)) - np.repeat(starts, size)).astype(np.uint64)
    return mixed(np.add.reduceat(mixed(hashes + place * np.uint64(0x9E3779B97F4A7C15)), starts) + size.astype(np.uint64))


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "line", "para", *(f"b{k}" for k in range(BANDS))]
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
        for lo, hi, texts in text_blocks(batch, "text"):
            words = split_words(texts)
            if not len(words.hash):
                continue
            used, starts, size = np.unique(words.line, return_index=True, return_counts=True)
            para = _content(words.hash, starts)
            long = size >= MIN_WORDS
            if not long.any():
                continue
            shingle, line = _shingles(words.hash, words.line)
            wanted = np.isin(line, used[long])
            shingle, line = shingle[wanted], line[wanted]
            first = np.searchsorted(line, used[long])
            columns = []
            for k in range(BANDS):
                key = np.full(long.sum(), _BAND_SALT[k])
                for m in _MULTIPLY[k * ROWS : (k + 1) * ROWS]:
                    value = shingle * m
                    key = mixed(key ^ np.minimum.reduceat(value ^ (value >> np.uint64(32)), first))
                columns.append(pa.array(key.view(np.int64)))
            text = words.text[starts[long]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[lo:hi][text]), pa.array((used[long] - words.first_line[text]).astype(np.int32)), pa.array(para[long].view(np.int64)), *columns],
                names=names,
            )


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, line, para, b0, b1, …): the paragraphs of MIN_WORDS words or more, a hash of the words, and a key for each band."""
    return _texts(docs).mapInArrow(_paragraphs, "doc_id long, line int, para long, " + ", ".join(f"b{k} long" for k in range(BANDS)))


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of the wanted lines of each text."""
    for batch in batches:
        wanted = batch.column(batch.schema.get_field_index("lines")).to_pylist()
        for lo, hi, texts in text_blocks(batch, "text"):
            words = split_words(texts)
            if not len(words.hash):
                continue
            lines = [words.first_line[i] + x for i, own in enumerate(wanted[lo:hi]) for x in own]
            used, starts = np.unique(words.line, return_index=True)
            asked = np.isin(used, lines)
            para = _content(words.hash, starts)[asked]
            shingle, line = _shingles(words.hash, words.line)
            begin = np.searchsorted(line, used[asked], side="left")
            end = np.searchsorted(line, used[asked], side="right")
            sets = [np.unique(shingle[a:b]).view(np.int64) for a, b in zip(begin, end)]
            edge = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate([*sets, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(para.view(np.int64)), pa.ListArray.from_arrays(pa.array(edge), pa.array(flat))], names=["para", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for group in groups(batches, ["key", "p", "q"]):
        para = group.column("para").to_numpy()
        lists = group.column("shingles").combine_chunks()
        flat = lists.flatten().to_numpy()
        size = np.diff(lists.offsets.to_numpy())
        start = np.cumsum(size) - size
        # places of each shingle, so that one member meets the others through the shingles they share
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(para)), size)[order]
        ranked = flat[order]
        low, high = np.searchsorted(ranked, flat, side="left"), np.searchsorted(ranked, flat, side="right")

        def linked(i: int) -> np.ndarray:
            own = slice(start[i], start[i] + size[i])
            reach = high[own] - low[own]
            spots = np.repeat(low[own] - np.cumsum(reach) + reach, reach) + np.arange(reach.sum())
            shared = np.bincount(owner[spots], minlength=len(para))
            return np.flatnonzero((shared > 0) & (shared >= similarity * (size + size[i] - shared)))

        label = forest(len(para), linked)
        first = np.unique(label, return_index=True)[1]
        root = np.zeros(len(para), np.int64)
        root[label[first]] = para[first]
        tied = root[label] != para
        a.extend(para[tied].tolist())
        b.extend(root[label][tied].tolist())
        if len(a) >= 65536:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def paragraph_classes(found: DataFrame) -> DataFrame:
    """(para, at, n, b0, …): each different paragraph with its first place and how often it stands. Combined on the map side, so that a
    paragraph of many documents is one row a task."""
    bands = [F.first(f"b{k}").alias(f"b{k}") for k in range(BANDS)]
    return found.groupBy("para").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.count("*").alias("n"), *bands)


def links(docs: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links that join paragraphs at `similarity` or more into components, one a member and bucket at most."""
    keys = F.explode(F.array(*[F.col(f"b{k}") for k in range(BANDS)])).alias("key")
    colliding = stored(members(classes.select("para", keys), "key", "para"), "colliding")
    # the text of one place of each colliding paragraph
    place = classes.select("para", "at").join(by_shuffle(colliding.select("para").distinct()), "para", "left_semi")
    asked = place.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list("at.line").alias("lines"))
    sets = stored(_texts(docs).join(asked, "doc_id").select("text", "lines").mapInArrow(_shingle_sets, "para long, shingles array<long>"), "shingles")
    # rows that repeat a doc_id may give a paragraph twice
    sets = sets.groupBy("para").agg(F.first("shingles").alias("shingles"))
    parts = chunked(colliding, "para").select("key", "p", "q", "para").join(by_shuffle(sets), "para")
    return bucket_order(parts.select("key", "p", "q", "para", "shingles"), "key").mapInArrow(lambda x: _similar(x, similarity), "a long, b long")


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
        for lo, hi, texts in text_blocks(batch, "text"):
            words = split_words(texts)
            run = runs(words.hash, MARK_WORDS)
            if len(run) < WINDOW:
                continue
            windows = np.lib.stride_tricks.sliding_window_view(run, WINDOW)
            whole = np.flatnonzero(words.text[: len(windows)] == words.text[PASSAGE_WORDS - 1 :])
            spot = np.zeros(len(run), bool)
            for at in range(0, len(whole), 16384):
                some = whole[at : at + 16384]
                spot[some + windows[some].argmin(axis=1)] = True
            at = np.flatnonzero(spot)
            # where words repeat over and over the same mark returns; the first and last of each WINDOW places are enough, as no run lies between two of them
            again = (run[at[1:]] == run[at[:-1]]) & (np.diff(at) < WINDOW) & (words.text[at[1:]] == words.text[at[:-1]])
            fresh = np.concatenate(([True], ~again))[: len(at)]
            since = (at - at[fresh][np.cumsum(fresh) - 1]) // WINDOW
            turn = np.concatenate(([True], fresh[1:] | (np.diff(since) != 0), [True]))[: len(at) + 1]
            at = at[turn[:-1] | turn[1:]]
            text = words.text[at]
            first = np.searchsorted(words.text, np.arange(hi - lo))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[lo:hi][text]), pa.array((at - first[text]).astype(np.int32)), pa.array(run[at].view(np.int64)),
                    pa.array((words.line[at] - words.first_line[text]).astype(np.int32)), pa.array((words.line[at + MARK_WORDS - 1] - words.first_line[text]).astype(np.int32)),
                ],
                names=["doc_id", "pos", "mark", "line", "last_line"],
            )


def _extended(mark: np.ndarray, low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of n places start a run of PASSAGE_WORDS words that holds a mark and lies in the mark's text, from low up to high."""
    begin, end = np.maximum(mark - WINDOW + 1, low), np.minimum(mark, high - PASSAGE_WORDS) + 1
    # a row whose text is not the one the marks were taken from (a repeated doc_id) has fewer words
    some = begin < end
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, begin[some], 1)
    np.subtract.at(depth, end[some], 1)
    return np.flatnonzero(np.cumsum(depth) > 0)


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of all runs of PASSAGE_WORDS words that hold a wanted mark, each once a text with the places where it starts. Runs that reach into
    lines that go are left out."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy()
        wanted, gone = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("marks", "lines"))
        for lo, hi, texts in text_blocks(batch, "text"):
            words = split_words(texts)
            run = runs(words.hash, PASSAGE_WORDS)
            bound = np.searchsorted(words.text, np.arange(hi - lo + 1))
            text = np.repeat(np.arange(hi - lo), [len(own) for own in wanted[lo:hi]])
            mark = bound[text] + np.array([pos for own in wanted[lo:hi] for pos in own], np.int64)
            start = _extended(mark, bound[text], bound[text + 1], len(run))
            blank = np.isin(words.line, [words.first_line[i] + x for i, own in enumerate(gone[lo:hi]) for x in own or []])
            before = np.concatenate(([0], np.cumsum(blank)))
            start = start[before[start + PASSAGE_WORDS] == before[start]]
            start = start[np.lexsort((start, run[start], words.text[start]))]
            text, run = words.text[start], run[start]
            first = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (text[1:] != text[:-1])))[: len(run)])
            starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(run)).astype(np.int32)), pa.array((start - bound[text]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][text[first]]), pa.array(run[first].view(np.int64)), starts], names=["doc_id", "run", "starts"])


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_small_batches(rows.filter("doc_id IS NOT NULL AND text IS NOT NULL"))


def spliced(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, starts, keeper): where runs of PASSAGE_WORDS words start, not across paragraphs that go, that an earlier document holds too. The keeper
    of a run is the first of all documents that hold it, whatever other runs share its marks. Documents that share a mark or a run are found by
    groupings that combine on the map side."""
    marks = stored(_texts(docs).mapInArrow(_marks, "doc_id long, pos int, mark long, line int, last_line int"), "marks")
    across = marks.groupBy("mark").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("mark")
    met = marks.join(by_shuffle(across), "mark", "left_semi")
    lines = by_shuffle(gone.select("doc_id", "line").distinct())
    left = stored(met.join(lines, ["doc_id", "line"], "left_anti").join(lines.withColumnRenamed("line", "last_line"), ["doc_id", "last_line"], "left_anti").select("doc_id", "pos", "mark"), "marks")
    again = left.groupBy("mark").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("mark")
    held = left.join(by_shuffle(again), "mark", "left_semi")
    asked = held.groupBy("doc_id").agg(F.collect_list("pos").alias("marks"))
    asked = asked.join(lines.groupBy("doc_id").agg(F.collect_list("line").alias("lines")), "doc_id", "left")
    windows = stored(_texts(docs).join(asked, "doc_id").mapInArrow(_around, "doc_id long, run long, starts array<int>"), "windows")
    shared = windows.groupBy("run").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).filter("keeper < last").drop("last")
    return windows.join(by_shuffle(shared), "run").filter("doc_id <> keeper").select("doc_id", "starts", "keeper")


def repeated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, line, group, keeper): the paragraphs that go. group is the smallest hash of the component, keeper the document in which it stays.

    Of all places of a component the one with the smallest (doc_id, line) stays, the others go, also those in the keeper itself."""
    found = stored(paragraphs(docs), "paragraphs")
    classes = stored(paragraph_classes(found), "paragraph-classes")
    rooted = components(links(docs, classes, similarity)).select(F.col("node").alias("para"), F.col("root").alias("group"))
    # without a link and a second place there is nothing to remove
    several = classes.select("para", "at", "n").join(by_shuffle(rooted), "para", "left").filter("group IS NOT NULL OR n > 1").withColumn("group", F.coalesce("group", "para"))
    stays = several.groupBy("group").agg(F.min("at").alias("stays"))
    named = stored(several.select("para", "group").join(stays, "group"), "passages")
    gone = found.select("doc_id", "line", "para").join(by_shuffle(named), "para")
    return gone.filter("doc_id <> stays.doc_id OR line <> stays.line").select("doc_id", "line", "group", F.col("stays.doc_id").alias("keeper"))


def cut(text: bytes, lines: list[int], spans: list[tuple[int, int]], least: int = PASSAGE_WORDS) -> tuple[bytes, int]:
    """The text without the lines and without the spans of words, and how many spans went: overlapping spans are one, and one of fewer than `least`
    words stays. A span goes up to the white space after it."""
    begin, end = edges(LOWER[np.frombuffer(text, np.uint8)])
    holes = []
    merged: list[list[int]] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    whole = [(a, b) for a, b in merged if b - a >= least]
    for a, b in whole:
        stop = int(end[b - 1])
        while stop < len(text) and text[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        start = int(begin[a])
        # of the two blanks around a hole one is enough
        if stop < len(text) and text[stop] == 32 and (start == 0 or text[start - 1] in b" \n"):
            stop += 1
        holes.append((start, stop))
    if lines:
        feeds = [-1, *[i for i, c in enumerate(text) if c == 10], len(text)]
        last = len(feeds) - 2
        # a line goes with the line feed after it; trailing lines with the one before
        holes += [(feeds[n] + 1, feeds[n + 1] + 1) for n in lines if n < last]
        tail = last
        while tail >= 0 and tail in set(lines):
            tail -= 1
        if tail < last:
            holes.append((max(feeds[tail + 1], 0), len(text)))
    out, at = [], 0
    for start, stop in sorted(holes):
        if start > at:
            out.append(text[at:start])
        at = max(at, stop)
    out.append(text[at:])
    return b"".join(out), len(whole)


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        column = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()
        texts, counts = [], []
        for text, lines, spans in zip(column("text"), column("removed"), column("_spans")):
            if text is None or not (lines or spans):
                texts.append(text)
                counts.append(0)
            else:
                left, n = cut(text.encode(), lines or [], [(s, s + PASSAGE_WORDS) for s in set(spans or [])])
                texts.append(left.decode())
                counts.append(n)
        kept = [n for n in names if n not in ("text", "_spans")]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[*kept, "text", "cuts"])


def cleaned(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All columns of `docs`, the text without its repeated paragraphs and passages, with `removed` (line numbers of the paragraphs, from 0), `cuts` (how many
    passages were cut within other lines) and `keepers` (the documents that keep what went).

    Rows without doc_id, null and empty texts stay as they are, with empty lists. Rows that repeat a doc_id are one document: paragraphs that go from it go from each.
    Columns named `removed`, `cuts` or `keepers` are replaced; others may have any name."""
    gone = stored(repeated(docs, similarity), "gone")
    spans = stored(spliced(docs, gone), "spans")
    by_line = gone.groupBy("doc_id").agg(F.collect_set("line").alias("lines"), F.collect_set("keeper").alias("a"))
    by_span = spans.groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("_spans"), F.collect_set("keeper").alias("b"))
    marks = by_line.join(by_span, "doc_id", "full").withColumnRenamed("doc_id", "_id")
    none = "CAST(array() AS array<{}>)"
    own, given = set_aside(docs.drop("removed", "cuts", "keepers").withColumn("text", F.col("text").cast("string")), "doc_id", "text")
    both = own.join(marks, F.col("doc_id").cast("long") == F.col("_id"), "left").select(
        *[F.col(c) for c in own.columns], F.sort_array(F.coalesce("lines", F.expr(none.format("int")))).alias("removed"), "_spans",
        F.sort_array(F.array_union(F.coalesce("a", F.expr(none.format("bigint"))), F.coalesce("b", F.expr(none.format("bigint"))))).alias("keepers"),
    )
    others = [f for f in both.schema.fields if f.name not in ("text", "_spans")]
    shape = StructType([*others, StructField("text", StringType()), StructField("cuts", IntegerType())])
    out = in_small_batches(both).mapInArrow(_cut_rows, shape)
    return out.select(*given, "removed", "cuts", "keepers")


def keep_rest(docs: DataFrame) -> DataFrame:
    """Documents with what is left of their texts and n_chars counted anew; those of which nothing but white space is left go. All other columns stay as they are,
    whatever their names."""
    plain, given = set_aside(docs, "doc_id", "text", "n_chars")
    touched = (F.size("removed") > 0) | (F.col("cuts") > 0)
    left = cleaned(plain).filter(~touched | F.col("text").rlike(r"\S"))
    if "n_chars" in plain.columns:
        count = F.when(touched, F.length("text").cast(plain.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", count)
    return left.select(*given)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cleaned(docs).select("doc_id", "text", (F.size("removed") + F.col("cuts")).cast("long").alias("n_removed"), "removed", "cuts", "keepers")
