"""A quality classifier on bytes: a small convolutional network in numpy, trained from labels and run on whole documents.

A document is cut into segments of SEGMENT bytes; two neighbours form a chunk, so chunks overlap by half and cover the whole text.
Filters of WIDTH bytes move over the bytes of a chunk in steps of two; each filter's largest activation in a chunk counts. Over
the chunks of a document their mean, maximum and minimum are combined into one probability by a logistic unit. Filters, byte
embeddings and the unit are learned together. A score depends on the bytes of its own text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestlens.llm.shared import in_small_batches, set_aside, table, text_blocks

WIDTH, FILTERS, DEPTH = 6, 24, 4
SEGMENT = 128
SLAB = 512  # segments that are convolved at once
THRESHOLD = 0.3
FOLDS = 5
# The fit reads this many labelled rows of each class at most, none longer than TRAIN_BYTES (longer ones are scored, not learned from).
TRAIN_ROWS = 2000
TRAIN_BYTES = 32768
EPOCHS, BATCH, RATE = 16, 32, 0.01


@dataclass
class Network:
    embedding: np.ndarray  # 256 x DEPTH; the padding byte 0 is all zero
    filters: np.ndarray  # WIDTH x DEPTH x FILTERS
    bias: np.ndarray
    weight: np.ndarray  # 3 * FILTERS: of the mean, the maximum and the minimum over chunks
    offset: float

    def byte_tables(self) -> np.ndarray:
        """What each byte adds to each filter at each place of a window: WIDTH x 256 x FILTERS."""
        return np.einsum("bd,kdf->kbf", self.embedding, self.filters).astype(np.float32)


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another, each behind WIDTH zeros and padded by zeros to whole segments, so that no window reaches
    from a text into the next; segments of each."""
    counts = np.array([-(-(len(t) + WIDTH) // SEGMENT) if t else 0 for t in texts], np.int64)
    raw = np.zeros(int(counts.sum()) * SEGMENT + SEGMENT, np.uint8)
    at = 0
    for t, n in zip(texts, counts):
        raw[at + WIDTH : at + WIDTH + len(t)] = np.frombuffer(t, np.uint8)
        at += int(n) * SEGMENT
    return raw, counts


def _segment_maxima(raw: np.ndarray, pairs: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """The largest activation of each filter in each segment. pairs: a table for each two places of a window, by two bytes."""
    two = raw.reshape(-1, 2)
    codes = two[:, 0].astype(np.int32) * 256 + two[:, 1]
    per = SEGMENT // 2
    n = len(codes) // per - 1
    out = np.empty((n, FILTERS), np.float32)
    for at in range(0, n, SLAB):
        stop = min(at + SLAB, n)
        lo, hi = at * per, stop * per
        acts = pairs[0][codes[lo:hi]]
        for k in range(1, WIDTH // 2):
            acts += pairs[k][codes[lo + k : hi + k]]
        out[at:stop] = acts.reshape(stop - at, per, FILTERS).max(axis=1)
    return out + bias


def _chunks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second segment of each chunk and its text; a text of one segment has one chunk."""
    chunks = np.maximum(counts - 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), chunks)
    begin = np.cumsum(counts) - counts
    first = begin[text] + np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    second = np.minimum(first + 1, (begin + counts - 1)[text])
    return first, second, text


def _pooled(maxima: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean, maximum and minimum over the chunks of each text; zeros for a text without bytes."""
    first, second, text = _chunks(counts)
    top = np.maximum(np.maximum(maxima[first], maxima[second]), 0)
    out = np.zeros((len(counts), 3 * FILTERS), np.float64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.searchsorted(text, full)
        each = np.bincount(text, minlength=len(counts))[full, None]
        out[full, :FILTERS] = np.add.reduceat(top.astype(np.float64), starts, axis=0) / each
        out[full, FILTERS : 2 * FILTERS] = np.maximum.reduceat(top, starts, axis=0)
        out[full, 2 * FILTERS :] = np.minimum.reduceat(top, starts, axis=0)
    return out


class Scorer:
    """A network made ready for whole batches of texts."""

    def __init__(self, net: Network):
        by_byte = net.byte_tables()
        self.net = net
        self.pairs = [(by_byte[k][:, None, :] + by_byte[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        raw, counts = _laid_out(texts)
        features = _pooled(_segment_maxima(raw, self.pairs, self.net.bias), counts)
        return 1 / (1 + np.exp(-np.clip((features * self.net.weight).sum(axis=1) + self.net.offset, -40, 40)))


def train(texts: list[bytes], marks: np.ndarray, share: float, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Fit by Adam on logistic loss with the classes in equal weight; then `share`, the part of ones among all labels, sets the offset.

    Without texts, or with one class only, the network answers the share itself for every text."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 1, (256, DEPTH)), rng.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH, DEPTH, FILTERS)), np.zeros(FILTERS), np.zeros(3 * FILTERS), 0.0,
    )
    net.embedding[0] = 0
    prior = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    ones = float(marks.sum())
    if not 0 < ones < len(marks):
        net.offset = prior
        return net
    by_class = np.where(marks == 1, len(marks) / (2 * ones), len(marks) / (2 * (len(marks) - ones)))
    net.weight = rng.normal(0, 0.1, 3 * FILTERS)
    offset = np.zeros(1)
    values = [net.embedding, net.filters, net.bias, net.weight, offset]
    speed, energy, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            net.offset = float(offset[0])
            slopes = _gradients(net, [texts[i] for i in pick], marks[pick], by_class[pick])
            step += 1
            rate = RATE * (1 - epoch / epochs) + RATE * 0.02
            for v, g, m, s in zip(values, slopes, speed, energy):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    net.offset = float(offset[0]) + prior
    return net


def _gradients(net: Network, texts: list[bytes], marks: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    raw, counts = _laid_out(texts)
    by_byte = net.byte_tables()
    per = SEGMENT // 2
    n = int(counts.sum())
    starts = np.arange(0, n * SEGMENT, 2)
    acts = np.zeros((len(starts), FILTERS), np.float32)
    for k in range(WIDTH):
        acts += by_byte[k][raw[starts + k]]
    acts = acts.reshape(n, per, FILTERS)
    where = acts.argmax(axis=1)
    maxima = np.take_along_axis(acts, where[:, None, :], axis=1)[:, 0] + net.bias
    features = _pooled(maxima.astype(np.float32), counts)
    guess = 1 / (1 + np.exp(-np.clip(features @ net.weight + net.offset, -40, 40)))
    error = (guess - marks) * weights / len(texts)
    first, second, text = _chunks(counts)
    seg = np.where(maxima[first] >= maxima[second], first[:, None], second[:, None])
    top = np.maximum(maxima[first], maxima[second])
    each = np.bincount(text, minlength=len(texts))
    slope = (error / np.maximum(each, 1))[text][:, None] * net.weight[:FILTERS]
    for k, side in ((1, 1), (2, -1)):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        ends = side * np.maximum(top, 0) >= side * features[text, own] - 1e-6
        slope = slope + np.where(ends, error[text][:, None] * net.weight[own], 0) / np.maximum(1, _sum_by(ends, text, len(texts))[text])
    slope = np.where(top > 0, slope, 0)
    filt = np.broadcast_to(np.arange(FILTERS), seg.shape)
    spot = seg * SEGMENT + 2 * where[seg, filt]
    d_filters, d_embedding = np.zeros_like(net.filters), np.zeros_like(net.embedding)
    for k in range(WIDTH):
        cell = raw[spot + k].astype(np.int64) * FILTERS + filt
        by = np.bincount(cell.ravel(), slope.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
        d_filters[k] = net.embedding.T @ by
        d_embedding += by @ net.filters[k].T
    d_embedding[0] = 0
    return [d_embedding, d_filters, slope.sum(axis=0), features.T @ error + 1e-4 * net.weight, np.array([error.sum()])]


def _sum_by(x: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, x.shape[1]))
    np.add.at(out, text, x)
    return out


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[bytes], np.ndarray, float]:
    """Texts and marks of at most `rows` labelled documents of each class outside the held-out fold, in an order by hash, and the share of
    ones. A document with several labels counts as one if their mean is one half or more; labels without id or value are left out."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.avg("quality") >= 0.5).cast("int").alias("mark")
    ).filter(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    counted = {r["mark"]: r["count"] for r in known.groupBy("mark").count().collect()}
    total = sum(counted.values())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").filter(
        F.octet_length("text") <= TRAIN_BYTES
    )
    order = F.xxhash64("doc_id", F.lit(11))
    # ids are picked before the texts are read, so only the picked texts move; twice the rows are picked, as some are too long
    ids = [known.filter(F.col("mark") == m).orderBy(order, "doc_id").limit(2 * rows) for m in (0, 1)]
    picked = texts.join(F.broadcast(ids[0].union(ids[1])), "doc_id")
    found = [picked.filter(F.col("mark") == m).orderBy(order, "doc_id", F.xxhash64("text")).limit(rows).select("text", "mark") for m in (0, 1)]
    got = found[0].union(found[1]).collect()
    return [r["text"].encode() for r in got], np.array([r["mark"] for r in got], np.int64), (counted.get(1, 0) / total if total else 0.5)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of `docs` with `held_out`, `score` and `predicted`.

    Null and empty texts get the score of a text without bytes. A row without doc_id is held out: it has no label. Nothing but the text
    enters a score, so repeated texts score alike. Columns of these three names are replaced, others may have any name. Without labels every score is one half."""
    net = train(*training_rows(docs, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net)
        for batch in batches:
            score = np.concatenate([scorer.scores(texts) for _, _, texts in text_blocks(batch, "_bytes")] or [np.zeros(0)])
            rest = batch.select([n for n in batch.schema.names if n != "_bytes"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(score)], names=[*rest.schema.names, "score"])

    own, given = set_aside(docs.drop("held_out", "score", "predicted"), "doc_id", "text")
    shape = own.withColumn("score", F.lit(0.0)).schema
    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % FOLDS == 0, F.lit(True))
    out = in_small_batches(own.withColumn("_bytes", F.col("text").cast("string"))).mapInArrow(scored, shape)
    return out.select(*given, held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns, whatever their names."""
    plain, given = set_aside(docs, "doc_id", "text")
    return score_documents(plain, labels).filter("predicted = 1").select(*given)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
