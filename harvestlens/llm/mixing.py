"""Mixing sources to target weights by soft domain membership.

A softmax classifier, trained on a labelled table, gives each document its domain posteriors. A document's tokens then count for each domain by its posterior, and
nonnegative rates, one a document, are fitted so that the expected tokens of each domain meet the targets: least squares of the domain totals by projected gradient
steps from rates of one, each along the gradient at its own end. Documents hold no state: a rate follows from the posteriors and the few steps so far, so
a step is some passes over a narrow table that sum, and a lost executor costs its own tasks only. Texts are scored once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from harvestlens.llm.shared import by_shuffle, in_small_batches, quoted, set_aside, stored, table, text_blocks

# Shares of the expected tokens that each domain is to have; domains are languages here.
TARGETS = {"de": 0.2, "en": 0.5, "es": 0.1, "fr": 0.2}
# The classifier reads this many labelled documents of each domain at most, none longer than TRAIN_BYTES.
TRAIN_ROWS, TRAIN_BYTES = 400, 32768
BUCKETS = 1024
# How near steps stay, one after another; Newton iterations of a step at most, and the lengths that one looks at.
NEARNESS, ITERATIONS, LENGTHS, TOLERANCE = (1e-2, 1e-3, 1e-4, 1e-5, 1e-6, 1e-7, 1e-8), 40, (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3, 1e-4), 1e-7


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of the shares of hashed byte pairs, and the number of words between white space, of each text."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    words = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text, np.uint8)
        if not len(raw):
            continue
        gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
        words[i] = int((~gap[1:] & gap[:-1]).sum()) + int(not gap[0])
        pair = raw[:-1].astype(np.uint32) * 256 + raw[1:]
        pair = (pair * np.uint32(2654435761)) >> np.uint32(22)
        out[i] = np.sqrt(np.bincount(pair, minlength=BUCKETS) / max(len(pair), 1))
    return out, words


def train(texts: list[bytes], marks: np.ndarray, classes: int, steps: int = 250, rate: float = 0.3) -> np.ndarray:
    """Weights, one column a class and a last row of offsets, by Adam on the cross entropy with all classes in equal weight. Without texts all
    posteriors are alike."""
    weights = np.zeros((BUCKETS + 1, classes))
    if not len(texts):
        return weights
    x = np.concatenate((features(texts)[0], np.ones((len(texts), 1), np.float32)), axis=1)
    each = np.bincount(marks, minlength=classes)
    scale = (1 / (each[marks] * (each > 0).sum()))[:, None]
    goal = np.eye(classes)[marks]
    speed, energy = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        slope = x.T @ ((posteriors(x, weights) - goal) * scale) + 1e-6 * weights
        speed += 0.1 * (slope - speed)
        energy += 0.01 * (slope * slope - energy)
        weights = weights - rate * (speed / (1 - 0.9**step)) / (np.sqrt(energy / (1 - 0.99**step)) + 1e-9)
    return weights


def posteriors(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    scores = x @ weights
    scores -= scores.max(axis=1, keepdims=True)
    out = np.exp(scores)
    return out / out.sum(axis=1, keepdims=True)


def _member(batch: pa.RecordBatch, name: str, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and posteriors of whole texts, block by block."""
    words, share = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, weights.shape[1]))
    for lo, hi, texts in text_blocks(batch, name):
        x, words[lo:hi] = features(texts)
        share[lo:hi] = posteriors(np.concatenate((x, np.ones((hi - lo, 1), np.float32)), axis=1), weights)
    return words, share


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], rows: int = TRAIN_ROWS) -> np.ndarray:
    """Train on at most `rows` documents of each domain of a labelled table (doc_id, domain), picked by hash of their ids. A document with two domains takes
    the first by name; domains that are not asked for and rows without id or domain are left out."""
    known = labelled.filter(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(
        (F.octet_length("text") > 0) & (F.octet_length("text") <= TRAIN_BYTES)
    )
    order = F.xxhash64("doc_id", F.lit(13))
    here = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    picked = None
    for domain in domains:
        some = here.filter(F.col("domain") == domain).orderBy(order, "doc_id").limit(rows)
        picked = some if picked is None else picked.union(some)
    got = texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return train([r["text"].encode() for r in got], np.array([domains.index(r["domain"]) for r in got], np.int64), len(domains))


def rates_of(share: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rate of each document after the given steps."""
    rate = np.ones(len(share))
    for step in steps:
        rate = np.maximum(0, rate - share @ step)
    return rate


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.flatten().to_numpy().reshape(-1, width)


def measured(share: np.ndarray, words: np.ndarray, steps: list[np.ndarray], ends: Sequence[np.ndarray]) -> np.ndarray:
    """For each way to end a next step: expected tokens of each domain, the Gram matrix of the documents whose rates stay above zero, and the squares of the rates,
    all weighted by words; a row each."""
    rate = rates_of(share, steps)
    out = []
    for end in ends:
        left = np.maximum(0, rate - share @ end)
        gram = share.T @ (share * (words * (left > 0))[:, None])
        out.append(np.concatenate([(words * left) @ share, gram.ravel(), [words @ (left * left)]]))
    return np.stack(out)


def _added(held: DataFrame, width: int, shape: tuple[int, int], part: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all documents of a small matrix of domains; each task sends one, and they are added by cell."""
    size = shape[0] * shape[1]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += part(_matrix(batch, "share", width), batch.column(batch.schema.get_field_index("words")).to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    out = np.zeros(size)
    for r in held.select("words", "share").mapInArrow(summed, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out.reshape(shape)


def fit_rates(added: Callable, targets: np.ndarray) -> list[np.ndarray]:
    """The projected gradient steps that lead to the rates with the least squared miss of the domain totals.

    `added(shape, part)` sums part(share, words) over all documents. A step goes along the gradient at its own end, 1 / d times as far, and stops at zero where a rate would
    fall below: it is the least squared miss plus d / 2 times the squared way, so it never overshoots however small d is, and small d leave a miss that is least up to d
    times the squared way. The end is told by its domain totals alone, so it is found by Newton's method in as many numbers as there are domains, and each
    iteration is one pass that looks at a few lengths at once."""
    width = len(targets)
    shape = (len(LENGTHS), width + width * width + 1)
    steps: list[np.ndarray] = []
    start = added((1, shape[1]), lambda share, words: measured(share, words, steps, [np.zeros(width)]))[0]
    total = start[width:-1].sum()  # posteriors add up to one, and so do their products
    if total <= 0:
        return []
    for d in NEARNESS:
        miss, end = start[:width] / total - targets, np.zeros(width)
        if np.abs(miss).sum() < TOLERANCE:
            break
        at, least = start, start[-1] / total / 2
        for _ in range(ITERATIONS):
            # the step ends where d times `end` is the miss there
            slope = d * end - (at[:width] / total - targets)
            if np.abs(slope).max() < TOLERANCE / 100:
                break
            way = np.linalg.solve(at[width:-1].reshape(width, width) / total + d * np.eye(width), slope)
            ends = [end - size * way for size in LENGTHS]
            seen = added(shape, lambda share, words: measured(share, words, steps, ends))
            height = [d / 2 * float(e @ e) + float(targets @ e) + x[-1] / total / 2 for e, x in zip(ends, seen)]
            best = int(np.argmin(height))
            if height[best] >= least:
                break
            end, at, least = ends[best], seen[best], height[best]
        if ((at[:width] / total - targets) ** 2).sum() > miss @ miss:
            break  # beyond what the arithmetic resolves
        steps = [*steps, end]
        start = at
    return steps


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, columns: list[str] | None = None) -> DataFrame:
    """All columns of `docs`, or those in `columns`, with words, posteriors (a map by domain) and rate: how often the document is to be taken on average.

    The rates times words times posteriors add up to targets (scaled to one) times all words, as far as nonnegative rates can. A null or empty text has no words; its
    rate follows from its posteriors all the same. Rows that repeat are documents of their own. Columns with these three names are replaced, others may have any name. Without labelled
    documents the posteriors are all alike; an empty table gives no rows."""
    domains = sorted(targets)
    goal = np.array([targets[d] for d in domains], float)
    goal = goal / goal.sum()
    weights = fit_classifier(docs, labelled, domains)
    width = len(domains)
    made = {"words", "posteriors", "rate"}
    wanted = [c for c in (docs.columns if columns is None else columns) if c.lower() not in made]
    own, given = set_aside(docs.select(*[quoted(c) for c in dict.fromkeys([*wanted, "text"])]), "text")
    given = given[: len(wanted)]
    own = own.withColumn("_bytes", F.col("text").cast("string"))
    if "text" not in wanted:
        own = own.drop("text")
    more = [StructField("words", LongType()), StructField("share", ArrayType(DoubleType()))]

    def member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, share = _member(batch, "_bytes", weights)
            rest = batch.select([n for n in batch.schema.names if n != "_bytes"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, share.size + 1, width, dtype=np.int32)), pa.array(share.ravel()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(words), lists], names=[*rest.schema.names, "words", "share"])

    # written once with the documents' columns: the steps read the two narrow columns, the result all
    scored = stored(in_small_batches(own).mapInArrow(member, StructType([*own.drop("_bytes").schema.fields, *more])), "posteriors")
    steps = fit_rates(partial(_added, scored, width), goal)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = rates_of(_matrix(batch, "share", width), steps)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "rate"])

    shape = StructType([*scored.schema.fields, StructField("rate", DoubleType())])
    out = in_small_batches(scored).mapInArrow(rated, shape)
    by_domain = F.map_from_arrays(F.array(*[F.lit(d) for d in domains]), F.col("share")).alias("posteriors")
    return out.select(*given, "words", by_domain, "rate")


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The labelled table: the documents that `labels` covers, and their language as domain."""
    covered = labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("domain")).join(by_shuffle(covered), "doc_id", "left_semi")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = mix(docs, labelled_languages(docs, labels), columns=["doc_id"])
    return out.select("doc_id", "words", *[F.col("posteriors")[d].alias(f"p_{d}") for d in sorted(TARGETS)], "rate")
