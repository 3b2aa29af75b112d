"""Cross-tokenizer alignment: two tokenizers' tokens of a text, cut into the smallest groups that cover the same bytes.

The cuts are found by divide and conquer. In an interval of tokens the end near the middle that both sides share is located by bisection: from the middle
end of one side, the first end of the other side at or after it, then back, until they meet or the interval ends; then downwards. Both halves go
on alike, all open intervals of a block in step, and an interval without a shared end is a group.

A text is encoded in stretches that begin at a single space between two characters that are no white space. Both tokenizers stop there: one splits the text
before such a space ahead of its merges, the other has no piece that goes on over a space. Equal stretches of a task are encoded and aligned once.

How often two ids are linked is counted over the corpus. A block of documents keeps its linked id pairs once, with their counts, its stretches the places
of their pairs among them, and each document its stretches, so the counts come back to a block and not to each document's links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestlens.llm.shared import in_small_batches, stored, table, text_blocks

TOKENIZERS = "/opt/tokenizers"
SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Bytes of text in a block of documents, and stretches that a task keeps, before it starts anew.
BLOCK_BYTES = 8 << 20
KEPT_STRETCHES = 250_000
# Characters of stretches that are encoded in one call.
CALL = 1 << 15
B_BITS = 20
STOP = r"(?<=\S) (?=\S)"
COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long"


@dataclass
class Side:
    """encode: the ids of a text's tokens; size: bytes of each id's token; pieces: those bytes."""

    encode: object
    pieces: list[bytes]
    size: np.ndarray = field(init=False)

    def __post_init__(self):
        self.size = np.array([len(p) for p in self.pieces], np.int64)


def byte_level(path: str) -> Side:
    """A byte-level tokenizer of a json file. In its entries each byte is written as one character: printable ones of Latin-1 as themselves, the others, in
    order, from code point 256 on."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    pieces = [b""] * tokenizer.get_vocab_size()
    for entry, i in tokenizer.get_vocab().items():
        pieces[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return Side(lambda text: tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces)


def sentence_pieces(path: str) -> Side:
    """A sentence-piece model with byte fallback, which puts a space before a text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.vocab_size()))]
    return Side(lambda text: model.encode(text, num_threads=1), pieces)


def sides(folder: str = TOKENIZERS) -> tuple[Side, Side]:
    return byte_level(f"{folder}/{SIDE_A}"), sentence_pieces(f"{folder}/{SIDE_B}")


def shared_ends(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> np.ndarray:
    """The ends that both sides share, in order. Ends of all sequences grow from one to the next; first_* hold where each sequence's tokens begin, and
    one entry more; the last ends of a sequence are equal."""
    a0, a1, b0, b1 = first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]
    some = a1 > a0
    a0, a1, b0, b1 = a0[some], a1[some], b0[some], b1[some]
    found = [ends_a[a1 - 1]]
    while True:
        # an interval with one token on a side is a group
        open_ = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[open_], a1[open_], b0[open_], b1[open_]
        if not len(a0):
            return np.sort(np.concatenate(found))
        cut_a, cut_b = np.full(len(a0), -1), np.full(len(a0), -1)
        middle = (a0 + a1 - 2) // 2
        for up in (True, False):
            at = np.flatnonzero(cut_a < 0)
            i = middle[at] if up else middle[at] - 1
            while len(at):
                inside = i <= a1[at] - 2 if up else i >= a0[at]
                at, i = at[inside], i[inside]
                j = np.searchsorted(ends_b, ends_a[i]) if up else np.searchsorted(ends_b, ends_a[i], side="right") - 1
                inside = j <= b1[at] - 2 if up else j >= b0[at]
                at, i, j = at[inside], i[inside], j[inside]
                met = ends_b[j] == ends_a[i]
                cut_a[at[met]], cut_b[at[met]] = i[met], j[met]
                at, j = at[~met], j[~met]
                i = np.searchsorted(ends_a, ends_b[j]) if up else np.searchsorted(ends_a, ends_b[j], side="right") - 1
        cut = cut_a >= 0
        a0, a1, b0, b1, i, j = (x[cut] for x in (a0, a1, b0, b1, cut_a, cut_b))
        found.append(ends_a[i])
        a0, a1, b0, b1 = (np.concatenate(x) for x in ((a0, i + 1), (i + 1, a1), (b0, j + 1), (j + 1, b1)))


class Stretches:
    """Stretches of text that were encoded and aligned, by number: their counts, the text of their groups, and the id pairs that they link."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        # each id as it is written within a group and at the end of its side, of the first tokenizer and then of the second
        self.words = [f"{i}{end}".encode() for side, last in ((a, "|"), (b, ";")) for i in range(len(side.pieces)) for end in (",", last)]
        self.word_size = np.array([len(w) for w in self.words], np.int64)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.unlike: set[int] = set()  # those that a tokenizer does not give back
        self.counts = [np.zeros((0, 4), np.int64)]  # n_a, n_b, n_groups, n_links; -1 where the bytes differ
        self.pairs = [np.zeros(0, np.int64)]

    def add(self, new: list[str]) -> None:
        plain = [s for s in new if s and not s[0].isspace() and not s[-1].isspace()]
        held = set(plain)
        batch, size = [], 0
        for s in plain:
            batch.append(s)
            size += len(s) + 1
            if size >= CALL:
                self._encoded(batch)
                batch, size = [], 0
        if batch:
            self._encoded(batch)
        for s in new:
            if s not in held:
                self._encoded([s])

    def _encoded(self, batch: list[str]) -> None:
        text = " ".join(batch)
        raw = f" {text}".encode()
        ids = [np.asarray(side.encode(text), np.int64) for side in (self.a, self.b)]
        sound = all(b"".join(map(side.pieces.__getitem__, own.tolist())) == raw for side, own in zip((self.a, self.b), ids))
        stops = np.cumsum([len(s) + 1 for s in batch] if text.isascii() else [len(s.encode()) + 1 for s in batch])
        first = []
        if sound:
            ends = [np.cumsum(side.size[own]) for side, own in zip((self.a, self.b), ids)]
            last = [np.searchsorted(e, stops) for e in ends]
            sound = all((e[at] == stops).all() for e, at in zip(ends, last))
            first = [np.concatenate(([0], at + 1)) for at in last]
        if sound:
            self._aligned(batch, ids, ends, first)
        elif len(batch) > 1:
            for s in batch:
                self._encoded([s])
        else:
            self.number[batch[0]] = len(self.groups)
            self.unlike.add(len(self.groups))
            self.groups.append(b"")
            self.counts.append(np.full((1, 4), -1, np.int64))

    def _aligned(self, batch: list[str], ids: list[np.ndarray], ends: list[np.ndarray], first: list[np.ndarray]) -> None:
        cuts = shared_ends(*ends, *first)
        group = [np.searchsorted(cuts, e) for e in ends]
        last = [np.append(np.diff(g) > 0, True) for g in group]
        # tokens as they are written: a group's of one side, then its of the other
        held = [np.concatenate(([0], np.cumsum(np.bincount(g, minlength=len(cuts))))) for g in group]
        place = np.concatenate((np.arange(len(ids[0])) + held[1][group[0]], np.arange(len(ids[1])) + held[0][group[1] + 1]))
        written = np.empty(len(place), np.int64)
        written[place] = np.concatenate((2 * ids[0] + last[0], 2 * (len(self.a.pieces) + ids[1]) + last[1]))
        # two tokens overlap in a range that ends where one of them does
        all_ends = np.sort(np.concatenate(ends), kind="stable")
        all_ends = all_ends[np.append(all_ends[1:] != all_ends[:-1], True)]
        over = [np.searchsorted(e, all_ends) for e in ends]
        self.pairs.append(ids[0][over[0]] << B_BITS | ids[1][over[1]])
        stops = ends[0][first[0][1:] - 1]
        n_groups = np.diff(np.searchsorted(cuts, stops) + 1, prepend=0)
        n_links = np.diff(np.searchsorted(all_ends, stops) + 1, prepend=0)
        self.counts.append(np.stack([np.diff(first[0]), np.diff(first[1]), n_groups, n_links], axis=1))
        at = np.concatenate(([0], np.cumsum(self.word_size[written])))[first[0] + first[1]].tolist()
        said = b"".join(map(self.words.__getitem__, written.tolist()))
        start = len(self.groups)
        self.groups += [said[i:j] for i, j in zip(at[:-1], at[1:])]
        self.number.update(zip(batch, range(start, start + len(batch))))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of every stretch, all pairs, and where each stretch's pairs begin."""
        self.counts, self.pairs = [np.concatenate(self.counts)], [np.concatenate(self.pairs)]
        return self.counts[0], self.pairs[0], np.concatenate(([0], np.cumsum(np.maximum(self.counts[0][:, 3], 0))))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values))


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "pairs", "times", "held", "often"]


def _block(block: int, ids: pa.Array, digests: list[str], held: list[np.ndarray], known: Stretches) -> Iterator[pa.RecordBatch]:
    """One row for the pairs of a block, with the places of its stretches' pairs among them, one stretch after another, and how many each stretch has; and
    one for each of its documents, with its stretches and how often they stand there."""
    counts, pairs, first = known.tables()
    n, most = len(held), max(len(counts), 1)
    doc = np.repeat(np.arange(n), [len(x) for x in held])
    stretch = np.concatenate([*held, np.zeros(0, np.int64)]).astype(np.int64)
    totals = np.stack([np.bincount(doc, weights=counts[stretch, k], minlength=n) for k in range(4)], axis=1).astype(np.int64)
    in_block = np.bincount(stretch, minlength=len(counts))
    own = np.flatnonzero(in_block)
    size = counts[own, 3]
    at = np.repeat(first[own], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    code, place = np.unique(pairs[at], return_inverse=True)
    total = np.bincount(place, weights=np.repeat(in_block[own], size), minlength=len(code)).astype(np.int64)
    # each stretch of a document once
    key, often = np.unique(doc * most + stretch, return_counts=True)
    sizes = np.bincount(key // most, minlength=n)
    which = np.zeros(most, np.int32)
    which[own] = np.arange(len(own))
    none = lambda kind, n: pa.nulls(n, kind)
    long, longs, ints = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())
    yield pa.RecordBatch.from_arrays(
        [none(long, 1)] * 5 + [none(pa.string(), 1), pa.array([block]), pa.array([code], longs), pa.array([total], longs)]
        + [pa.array([x.astype(np.int32)], ints) for x in (place, size)], names=NAMES
    )
    rows = pa.RecordBatch.from_arrays(
        [ids, *(pa.array(totals[:, k]) for k in range(4)), pa.array(digests, pa.string()), pa.array(np.full(n, block)), none(longs, n), none(longs, n)]
        + [_lists(which[key % most], sizes), _lists(often.astype(np.int32), sizes)], names=NAMES,
    )
    for start in range(0, n, 1000):
        yield rows.slice(start, 1000)


def _encoded(batches: Iterator[pa.RecordBatch], folder: str, block_bytes: int, kept: int) -> Iterator[pa.RecordBatch]:
    known, task, number = Stretches(*sides(folder)), TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    stop = re.compile(STOP)
    ids, digests, held, size = [], [], [], 0
    for batch in batches:
        for start, end, texts in text_blocks(batch, "text"):
            split = [stop.split(t.decode()) if t else [] for t in texts]
            new = {s for own in split for s in own}.difference(known.number)
            known.add(sorted(new))
            for own in split:
                numbers = [known.number[s] for s in own]
                if not known.unlike.isdisjoint(numbers):
                    numbers = []
                held.append(np.array(numbers, np.int32))
                digests.append(hashlib.sha256(b"".join(map(known.groups.__getitem__, numbers))[:-1]).hexdigest() if numbers else "")
            ids.append(batch.column(0).slice(start, end - start))
            size += sum(map(len, texts))
            if size >= block_bytes or len(known.groups) >= kept:
                yield from _block(task << 32 | number, pa.concat_arrays(ids), digests, held, known)
                ids, digests, held, size, number = [], [], [], 0, number + 1
                if len(known.groups) >= kept:
                    known.clear()
    if ids:
        yield from _block(task << 32 | number, pa.concat_arrays(ids), digests, held, known)


def _scored(rows: pa.Table, values: pa.Table) -> pa.Table:
    """The documents of a block with the counts of their links, which are summed up for its stretches first."""
    place = values.column("place").to_numpy()
    n, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    n[place], best[place] = values.column("n").to_numpy(), values.column("best").to_numpy(zero_copy_only=False)
    is_block = pc.is_null(rows.column("n_a"))
    pairs, docs = rows.filter(is_block), rows.filter(pc.invert(is_block))
    held, often = docs.column("held").combine_chunks(), docs.column("often").combine_chunks()
    at, times, edge = held.flatten().to_numpy(), often.flatten().to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(held.value_lengths().to_numpy())))
    linked, size = (pairs.column(c).combine_chunks().flatten().to_numpy() for c in ("held", "often"))
    ends = np.concatenate(([0], np.cumsum(size)))

    def total(x: np.ndarray) -> pa.Array:
        own = np.diff(np.concatenate(([0], np.cumsum(x[linked])))[ends])
        return pa.array(np.diff(np.concatenate(([0], np.cumsum(own[at] * times)))[edge]))

    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return out.add_column(5, "n_best", total(best)).add_column(6, "count_sum", total(n))


def align(docs: DataFrame, folder: str = TOKENIZERS, block_bytes: int = BLOCK_BYTES, kept: int = KEPT_STRETCHES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row.

    A null or empty text, and one that a tokenizer does not give back byte by byte, has no tokens: zeros and an empty string. Rows that repeat count as often
    as they stand there, rows without doc_id are aligned like any other, further columns are not read, and an empty table gives no rows. A stretch without a
    single space is encoded in one call, however long. `folder` holds the vocabulary files and must be there on every executor."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = f"{COLUMNS}, pairs array<long>, times array<long>, held array<int>, often array<int>"
    encoded = stored(in_small_batches(rows).mapInArrow(lambda x: _encoded(x, folder, block_bytes, kept), shape), "aligned")
    linked = encoded.filter("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "x")).select("block", "place", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = linked_counts(linked)
    back = linked.select(F.col("block").alias("of"), "place", "pair").join(counts, "pair").select("of", "place", "n", "best")
    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return encoded.drop("pairs", "times").groupBy("block").cogroup(back.groupBy("of")).applyInArrow(_scored, shape)


def linked_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold two ids linked, and whether no other first id is linked more often to the second. As many rows at
    most as pairs of ids are met."""
    counts = stored(linked.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND((1 << B_BITS) - 1)), "pairs")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    return stored(counts.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "counts")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
