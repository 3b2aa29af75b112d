"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One edit changes letter counts by two at most: a letter replaced by another takes one count up and one down, a letter put in takes one up. So a word's
neighbours of the same length, and those that are one longer, lie in a small box around its counts, and a tree over counts needs only be
searched where its boxes meet that one. What a search returns is then compared letter by letter.

Lengths with many words are cut into cells by the top of a tree that is fitted on a sample of words; every word is a point of one cell, and asks in each
cell that its box meets. A cell is searched in one task by a tree over all its points; the points of an overfull cell, and those that ask there, are
dealt to a grid of parts, where each point meets each asking word once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestlens.llm.shared import groups, stored, table

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Which occurrences lose a letter, the shortest word, the fewest occurrences, and how much more frequent a form is.
EVERY, SHORTEST, FEWEST, TIMES = 97, 5, 3, 2
# Words that the tops of the trees are fitted on, words of a cell, words that ask in a part of a cell, points of a leaf.
SAMPLE, CELL, ASKING, LEAF = 40_000, 8_000, 40_000, 8
# Letters as counted: a to z, then the letters of Latin-1 from 0xC0 on.
LETTER = np.zeros(256, np.int64)
LETTER[97:123] = np.arange(26)
LETTER[0xC0:] = np.arange(26, 90)
LETTERS = 90
POINT, SAME, LONGER = 0, 1, 2


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, size): the words of a corpus that stand there often enough, with their counts and lengths. Null texts have none; an occurrence in a row
    without doc_id is one of an empty id."""
    # a run that is too short is none from the start: only whole runs are this long
    long = F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN.replace("+", f"{{{SHORTEST},}}")), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(long).alias("run"))
    # lower() would change letters beyond A-Z too, so it is for runs that have no others
    plain = F.octet_length("run") == F.char_length("run")
    runs = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"))
    marked = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h")).withColumn("at", (F.col("h") % F.char_length("run")).cast("int"))
    less = F.concat(F.substr("run", F.lit(1), F.col("at")), F.substr("run", F.col("at") + 2))
    whole = F.col("h") % EVERY != 0
    words = marked.filter((F.char_length("run") > SHORTEST) | whole).select(F.when(whole, F.col("run")).otherwise(less).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= FEWEST)
    return counts.withColumn("size", F.char_length("word"))


def letter_counts(codes: list[bytes]) -> np.ndarray:
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    letters = LETTER[np.frombuffer(b"".join(codes), np.uint8)]
    flat = np.bincount(np.repeat(np.arange(len(codes)), sizes) * LETTERS + letters, minlength=len(codes) * LETTERS)
    return flat.reshape(len(codes), LETTERS).astype(np.int32)


def marks(counts: np.ndarray) -> np.ndarray:
    """Two words of bits for each row of letter counts: whether a to z are there once, twice and three times, and whether the others are, some of which share
    a bit. A bit that one row has and another has not is a letter that the other must gain."""
    there = counts > 0
    shared = there[:, 26:64].copy()
    shared[:, : LETTERS - 64] |= there[:, 64:]
    bits = np.concatenate((there[:, :26], shared, counts[:, :26] > 1, counts[:, :26] > 2, np.zeros((len(counts), 12), bool)), axis=1)
    return np.packbits(bits, axis=1).view(np.uint64)


def lacking(of: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many marks of `of` each row of `own` lacks."""
    return np.bitwise_count(of[:, 0] & ~own[:, 0]) + np.bitwise_count(of[:, 1] & ~own[:, 1])


@dataclass
class Tree:
    """Nodes by number: rows with at most `cut` of letter `letter` are under `low`, the others under `high`; a child below zero is the leaf ~child."""

    letter: list[int]
    cut: list[int]
    low: list[int]
    high: list[int]
    leaves: int

    def leaf_of(self, counts: np.ndarray) -> np.ndarray:
        node = np.zeros(len(counts), np.int64) if self.letter else np.full(len(counts), -1)
        letter, cut, low, high = (np.array([*x, 0]) for x in (self.letter, self.cut, self.low, self.high))
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            node[inner] = np.where(counts[inner, letter[at]] <= cut[at], low[at], high[at])
        return ~node

    def met(self, counts: np.ndarray, up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves whose box holds what can come of a row by at most `up` letters more and `down` letters fewer."""
        none = np.zeros(len(counts), np.int32)
        open_ = [(0 if self.letter else -1, np.arange(len(counts)), none, none, {})]
        rows, leaves = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while open_:
            node, row, more, fewer, box = open_.pop()
            if not len(row):
                continue
            if node < 0:
                rows.append(row)
                leaves.append(np.full(len(row), ~node))
                continue
            letter, cut = self.letter[node], self.cut[node]
            least, most = box.get(letter, (0, np.iinfo(np.int32).max))
            own = counts[row, letter]
            # what the tighter bound of this letter adds to the distance from the box
            gone = fewer + np.maximum(own - cut, 0) - np.maximum(own - most, 0)
            keep = gone <= down
            open_.append((self.low[node], row[keep], more[keep], gone[keep], box | {letter: (least, cut)}))
            come = more + np.maximum(cut + 1 - own, 0) - np.maximum(least - own, 0)
            keep = come <= up
            open_.append((self.high[node], row[keep], come[keep], fewer[keep], box | {letter: (cut + 1, most)}))
        return np.concatenate(rows), np.concatenate(leaves)


def fitted(counts: np.ndarray, most: float) -> Tree:
    """A tree whose leaves hold `most` rows or fewer, cut where a letter's count divides the rows most evenly; equal rows stay together."""
    tree = Tree([], [], [], [], 0)
    open_: list[tuple[np.ndarray, int, bool]] = [(np.arange(len(counts)), -1, False)]
    while open_:
        rows, parent, is_high = open_.pop()
        best = (1.0, 0, 0)
        if len(rows) > most:
            own = counts[rows]
            varied = np.flatnonzero(own.min(axis=0) != own.max(axis=0))
            for letter in varied.tolist():
                held = np.cumsum(np.bincount(own[:, letter]))[:-1] / len(rows)
                at = int(np.abs(held - 0.5).argmin())
                best = min(best, (abs(held[at] - 0.5), letter, at))
        if best[0] >= 0.5:
            child = ~tree.leaves
            tree.leaves += 1
        else:
            child = len(tree.letter)
            tree.letter.append(best[1])
            tree.cut.append(best[2])
            tree.low.append(0)
            tree.high.append(0)
            below = counts[rows, best[1]] <= best[2]
            open_ += [(rows[below], child, False), (rows[~below], child, True)]
        if parent >= 0:
            (tree.high if is_high else tree.low)[parent] = child
    return tree


def tops(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> dict[int, Tree]:
    """The top of the tree of each length that has more words than a cell holds, fitted on a sample of `sample` of those words, drawn by their hashes.
    A cell gets eight sample words at least."""
    lengths = words.groupBy("size").agg(F.count("*").alias("n")).filter(F.col("n") > cell)
    total = lengths.agg(F.sum("n")).first()[0]
    if not total:
        return {}
    share = min(1.0, sample / total)
    drawn = words.filter(F.pmod(F.xxhash64(F.lit(11), "word"), F.lit(1 << 30)) < int(share * (1 << 30))).join(lengths, "size", "left_semi").select("word").collect()
    held: dict[int, list[bytes]] = {}
    for row in drawn:
        held.setdefault(len(row["word"]), []).append(row["word"].encode("latin-1"))
    return {size: fitted(letter_counts(codes), max(cell * share, 8)) for size, codes in held.items()}


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.Table]:
    """Batches joined to tables of about `most` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _cells(batches: Iterator[pa.RecordBatch], trees: dict[int, Tree]) -> Iterator[pa.RecordBatch]:
    """Each word as a point of its cell, and as one that asks in the cells its box meets, among words of its length and of one more."""
    names, one = ["cell", "kind", "word", "n"], Tree([], [], [], [], 1)
    for part in _gathered(batches):
        sizes = part.column("size").to_numpy()
        order = np.argsort(sizes, kind="stable")
        part = part.take(pa.array(order)).combine_chunks()
        sizes = sizes[order]
        for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(sizes)) + 1):
            if not len(rows):
                continue
            size = int(sizes[rows[0]])
            own = part.slice(int(rows[0]), len(rows))
            counts = letter_counts([w.encode("latin-1") for w in own.column("word").to_pylist()])
            same, longer = trees.get(size, one), trees.get(size + 1, one)
            found = [(POINT, size, np.arange(len(rows)), same.leaf_of(counts)), (SAME, size, *same.met(counts, 1, 1)), (LONGER, size + 1, *longer.met(counts, 1, 0))]
            for kind, of, row, leaf in found:
                picked = own.select(["word", "n"]).take(pa.array(row)).combine_chunks()
                cells = pa.array((np.int64(of) << 24) + leaf)
                kinds = pa.array(np.full(len(row), kind, np.int32))
                yield from pa.Table.from_arrays([cells, kinds, picked.column("word"), picked.column("n")], names=names).to_batches(max_chunksize=1 << 16)


class Points:
    """Words of one length under a tree of their letter counts, for those that ask among them."""

    def __init__(self, points: list[bytes]):
        counts = letter_counts(points)
        self.used = np.flatnonzero(counts.any(axis=0))
        self.tree = fitted(counts[:, self.used], LEAF)
        leaf = self.tree.leaf_of(counts[:, self.used])
        self.order = np.argsort(leaf, kind="stable")
        self.first = np.searchsorted(leaf[self.order], np.arange(self.tree.leaves + 1))
        self.marks = marks(counts)
        # what all points of a leaf have, and what any has: a tighter box than the cuts make
        self.low, self.high = (f.reduceat(self.marks[self.order], self.first[:-1], axis=0) for f in (np.bitwise_and, np.bitwise_or))
        self.letters = np.frombuffer(b"".join(points), np.uint8).reshape(len(points), -1)

    def near(self, asking: list[bytes], longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """(asking, point) of all pairs one edit apart; those that ask have the points' length or, if `longer` is set, one less."""
        given, counts = np.frombuffer(b"".join(asking), np.uint8).reshape(len(asking), -1), letter_counts(asking)
        own, up, down = marks(counts), 1, 0 if longer else 1
        row, at = self.tree.met(counts[:, self.used], up, down)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for start in range(0, len(row), 1 << 18):
            r, l = row[start : start + (1 << 18)], at[start : start + (1 << 18)]
            asked = own[r]
            keep = (lacking(self.low[l], asked) <= up) & (lacking(asked, self.high[l]) <= down)
            for r, p in _pairs(r[keep], l[keep], self.first, self.order):
                asked, held = own[r], self.marks[p]
                keep = (lacking(held, asked) <= up) & (lacking(asked, held) <= down)
                r, p = r[keep], p[keep]
                near = _one_longer(given[r], self.letters[p]) if longer else (given[r] != self.letters[p]).sum(axis=1) == 1
                found.append((r[near], p[near]))
        return tuple(np.concatenate(x) for x in zip(*found))


def near_in(points: list[bytes] | Points, asking: list[bytes], longer: bool) -> tuple[np.ndarray, np.ndarray]:
    """(asking, point) of all pairs one edit apart; points have one length, those that ask the same or, if `longer` is set, one less."""
    if not points or not asking:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (points if isinstance(points, Points) else Points(points)).near(asking, longer)


def _pairs(row: np.ndarray, leaf: np.ndarray, first: np.ndarray, order: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, point) for the points of each row's leaf, about `most` at a time."""
    size = first[leaf + 1] - first[leaf]
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
    for r, l, n in zip(np.split(row, cuts), np.split(leaf, cuts), np.split(size, cuts)):
        if len(r):
            ends = np.cumsum(n)
            yield np.repeat(r, n), order[np.repeat(first[l], n) + np.arange(ends[-1]) - np.repeat(ends - n, n)]


def _one_longer(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether a row of `long` is the row of `short` with one letter put in: what they share from the left and from the right covers the shorter."""
    n = short.shape[1]
    left = np.cumprod(short == long[:, :n], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    right = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return left + right >= n


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, ["cell", "p", "q"]):
        kind = group.column("kind").to_numpy()
        own = {k: group.take(pa.array(np.flatnonzero(kind == k))).combine_chunks() for k in (POINT, SAME, LONGER)}
        codes = {k: [w.encode("latin-1") for w in x.column("word").to_pylist()] for k, x in own.items()}
        points = codes[POINT] and Points(codes[POINT])
        for k in (SAME, LONGER):
            row, point = near_in(points, codes[k], k == LONGER)
            ask, of = (own[x].select(["word", "n"]).take(pa.array(at)) for x, at in ((k, row), (POINT, point)))
            # a longer word does not ask for shorter ones
            ways = [(ask, of)] + [(of, ask)] * (k == LONGER)
            for x, y in ways:
                yield from pa.Table.from_arrays([x.column("word"), y.column("word"), y.column("n")], names=["word", "near", "near_n"]).to_batches(max_chunksize=1 << 16)


def near_words(words: DataFrame, cell: int = CELL, asking: int = ASKING, sample: int = SAMPLE) -> DataFrame:
    """(word, near, near_n): every ordered pair of words one edit apart, once; `words` holds each word once, with its n and size."""
    trees = tops(words, cell, sample)
    routed = stored(words.select("word", "n", F.col("size").cast("long").alias("size")).mapInArrow(lambda x: _cells(x, trees), "cell long, kind int, word string, n long"), "cells")
    is_point = F.col("kind") == POINT
    sizes = routed.groupBy("cell").agg(F.ceil(F.sum(is_point.cast("int")) / cell).cast("int").alias("ps"), F.ceil(F.sum((~is_point).cast("int")) / asking).cast("int").alias("qs"))
    # a cell without points or without words that ask has no pairs
    dealt = routed.join(sizes.filter("ps > 0 AND qs > 0"), "cell")
    own = F.pmod(F.xxhash64(F.lit(5), "word"), F.when(is_point, F.col("ps")).otherwise(F.col("qs")).cast("long")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_point, F.col("qs")).otherwise(F.col("ps")) - 1)))
    dealt = dealt.select("cell", F.when(is_point, F.col("own")).otherwise(F.col("other")).alias("p"), F.when(is_point, F.col("other")).otherwise(F.col("own")).alias("q"), "kind", "word", "n")
    return dealt.repartition("cell", "p", "q").sortWithinPartitions("cell", "p", "q").mapInArrow(_near, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: where the chain of forms ends. A form is at least TIMES as frequent as its word, so a chain has no more
    steps than the largest count can be halved, and each round doubles the steps that are taken. Words at their root are only looked up from then on."""
    led = stored(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("done")), "forms")
    while True:
        onward = led.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = led.filter("NOT done").join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNull().alias("done"))
        led = stored(moved.unionByName(led.filter("done")), "forms")
        if led.filter("NOT done").isEmpty():
            return led.select("word", "root")


def variants(docs: DataFrame, cell: int = CELL, asking: int = ASKING, sample: int = SAMPLE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the corpus.

    Null and empty texts have no words, rows that repeat count as often as they stand there, further columns are not read, and an empty table gives no rows.
    Ties for the most frequent near word go to the smallest in code-point order."""
    words = stored(word_counts(docs), "words")
    near = near_words(words, cell, asking, sample).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    led = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    is_form = F.col("form_n") >= TIMES * F.col("n")
    led = led.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    led = stored(led, "led")
    ends = roots(led.filter("form IS NOT NULL"))
    return led.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
