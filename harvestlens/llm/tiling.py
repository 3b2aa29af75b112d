"""Benchmark decontamination by greedy string tiling.

Runs of SEED_WORDS words that a document shares with a benchmark item are the seeds. Seeds that follow each other in both texts
form matches; the longest match whose words are still free on both sides becomes a tile, again and again, and the tiles together tell how much of the
item stands in the document, in whatever order. Run hashes are rolling ones over word hashes (Karp-Rabin). A match of SEED_WORDS words or more consists
of seeds, so the tiling needs the places of the seeds and no texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestlens.llm.shared import by_shuffle, groups, in_small_batches, quoted, stored, table, text_blocks
from harvestlens.llm.words import runs, split_words

SEED_WORDS = 5
COVERAGE = 0.5
# Bits of the sieve that most words of the corpus fail: its size is fixed, a larger benchmark only fills it more.
SIEVE_BITS = 24


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = batch.column(batch.schema.get_field_index("item")).to_numpy(zero_copy_only=False)
        for lo, hi, texts in text_blocks(batch, "text"):
            words = split_words(texts)
            count = np.bincount(words.text, minlength=hi - lo)
            seed = runs(words.hash, SEED_WORDS)
            whole = words.text[: len(seed)] == words.text[SEED_WORDS - 1 :] if len(seed) else np.zeros(0, bool)
            at = np.flatnonzero(whole)
            text = words.text[at]
            place = at - (np.cumsum(count) - count)[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed[at].view(np.int64)), pa.array(items[lo:hi][text]), pa.array(place.astype(np.int32)), pa.array(count[text].astype(np.int32))],
                names=["seed", "item", "item_pos", "item_words"],
            )


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """(seed, item, item_pos, item_words); an item is a text here, so repeated items count once. Items of fewer than SEED_WORDS words have none."""
    texts = benchmark.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    return texts.select(F.xxhash64("text").alias("item"), "text").mapInArrow(_seeds, "seed long, item long, item_pos int, item_words int")


def sieve(seeds: DataFrame) -> np.ndarray:
    """A bit for each seed's low bits, made up on the executors; its words, 2**18 at most, come to the driver."""
    slot = F.col("seed").bitwiseAND((1 << SIEVE_BITS) - 1)
    held = seeds.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(seed & 63 AS INT)))").alias("bits"))
    out = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    for r in held.collect():
        out[r["word"]] = np.uint64(r["bits"] & (2**64 - 1))
    return out


def document_runs(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc_id, doc_pos, run, seeds): stretches of following seeds of a document that pass the sieve; run names their content."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
            for lo, hi, texts in text_blocks(batch, "text"):
                words = split_words(texts)
                seed = runs(words.hash, SEED_WORDS)
                if not len(seed):
                    continue
                slot = seed & np.uint64((1 << SIEVE_BITS) - 1)
                hit = (held[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
                hit &= words.text[: len(seed)] == words.text[SEED_WORDS - 1 :]
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                text = words.text[at]
                cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(text) > 0)) + 1
                edge = np.concatenate(([0], cut, [len(at)]))
                values = seed[at].view(np.int64)
                first = np.searchsorted(words.text, np.arange(hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[lo:hi][text[edge[:-1]]]),
                        pa.array((at - first[text])[edge[:-1]].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(values)),
                    ],
                    names=["doc_id", "doc_pos", "seeds"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return in_small_batches(rows).mapInArrow(found, "doc_id long, doc_pos int, seeds array<long>").withColumn("run", F.xxhash64("seeds"))


def tiles(places: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """(doc_pos, item_pos, words) of the tiles. places: rows of (doc_pos, item_pos) of the seeds."""
    places = np.unique(places, axis=0)
    diagonal = places[:, 0] - places[:, 1]
    order = np.lexsort((places[:, 0], diagonal))
    places, diagonal = places[order], diagonal[order]
    cut = np.flatnonzero((np.diff(diagonal) != 0) | (np.diff(places[:, 0]) != 1)) + 1
    edge = np.concatenate(([0], cut, [len(places)]))
    waiting = [(-(int(b - a) + least - 1), int(places[a, 0]), int(places[a, 1])) for a, b in zip(edge[:-1], edge[1:])]
    heapq.heapify(waiting)
    in_doc: set[int] = set()
    in_item: set[int] = set()
    out = []
    while waiting:
        words, d, i = heapq.heappop(waiting)
        words = -words
        free = [d + k not in in_doc and i + k not in in_item for k in range(words)]
        if all(free):
            out.append((d, i, words))
            in_doc.update(range(d, d + words))
            in_item.update(range(i, i + words))
            continue
        start = None
        for k, is_free in enumerate([*free, False]):
            if is_free and start is None:
                start = k
            elif not is_free and start is not None:
                if k - start >= least:
                    heapq.heappush(waiting, (-(k - start), d + start, i + start))
                start = None
    return out


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item", "item_words", "covered", "n_tiles", "longest"]
    out: list[tuple] = []
    kinds = [pa.int64()] * len(names)
    for group in groups(batches, ["doc_id", "item"]):
        doc, item, size = (group.column(n)[0].as_py() for n in ("doc_id", "item", "item_words"))
        start = group.column("doc_pos").to_numpy()
        matched = group.column("places").combine_chunks()
        if isinstance(matched, pa.ChunkedArray):
            matched = pa.concat_arrays(matched.chunks)
        flat = matched.flatten()
        counts = np.diff(matched.offsets.to_numpy())
        offset, place = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        found = tiles(np.stack((np.repeat(start, counts) + offset, place), axis=1))
        out.append((doc, item, size, sum(t[2] for t in found), len(found), max(t[2] for t in found)))
        if len(out) >= 8192:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out = []
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, item_words, covered, coverage, n_tiles, longest) of the documents that hold `coverage` or more of an item's words in tiles.

    Rows without doc_id or item_id are not judged; null and empty texts hold nothing; items of fewer than SEED_WORDS words have no seed and are never
    found. Rows that repeat a doc_id count as one document. Item ids with the same text all appear. Empty tables give no rows.
    """
    seeds = stored(item_seeds(benchmark), "seeds")
    held = stored(document_runs(docs, sieve(seeds)), "runs")
    # a passage that many documents share is one run: it meets the seeds once
    contents = held.groupBy("run").agg(F.first("seeds").alias("seeds")).select("run", F.posexplode("seeds").alias("at", "seed"))
    met = contents.join(by_shuffle(seeds), "seed").groupBy("run", "item").agg(F.collect_list(F.struct("at", "item_pos")).alias("places"), F.max("item_words").alias("item_words"))
    matched = held.select("doc_id", "doc_pos", "run").join(by_shuffle(met), "run").select("doc_id", "item", "item_words", "doc_pos", "places")
    dealt = matched.repartition("doc_id", "item").sortWithinPartitions("doc_id", "item")
    tiled = dealt.mapInArrow(_tiled, "doc_id long, item long, item_words long, covered long, n_tiles long, longest long")
    judged = tiled.withColumn("coverage", F.col("covered") / F.col("item_words")).filter(F.col("coverage") >= coverage)
    named = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.col("text").cast("string")).alias("item")).distinct()
    return judged.join(named, "item").select("doc_id", "item_id", "item_words", "covered", "coverage", "n_tiles", "longest")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; rows without doc_id stay."""
    return docs.join(leaks(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select([quoted(c) for c in docs.columns])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
