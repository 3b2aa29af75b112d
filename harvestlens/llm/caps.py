"""Near-duplicate vectors by spherical-cap filters from random product codes.

A vector is turned at random and cut into blocks; each block has a random code of unit directions, and a filter is one codeword of each block. A vector
belongs to all filters whose direction it meets at an inner product above a threshold; they are listed block by block, dropping what cannot reach the
threshold any more, without looking at all filters. Several such codes with turns of their own keep the lists of a vector from standing or falling together.
Vectors that share a filter meet, and their cosine decides. The thresholds are such that a random vector belongs to `each` filters of a code on average.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, FloatType

from harvestlens.llm.buckets import CHUNK, bucket_order, chunked, forest, members
from harvestlens.llm.components import components
from harvestlens.llm.shared import groups, spread, stored, table

COSINE = 0.9
SEED = 31


def _shape(size: int) -> tuple[int, int, int, int]:
    """(codes, blocks, codewords of a block, filters each) for vectors of `size` components: more than nine in ten of the pairs
    at the threshold share a filter (tests)."""
    return (8, 2, 128, 5) if size >= 24 else (10, 2, 64, 6) if size >= 8 else (4, 1, 256, 24)


class ProductCode:
    """The filters of one code: fixed by size, number and seed."""

    def __init__(self, size: int, number: int, seed: int = SEED):
        _, self.blocks, self.words, each = _shape(size)
        rng = np.random.default_rng([seed, size, number])
        self.turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
        self.cuts = [len(x) for x in np.array_split(np.arange(size), self.blocks)]
        self.codes = []
        for n in self.cuts:
            code = rng.normal(size=(self.words, n))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True))
        trial = rng.normal(size=(64, size))
        scores = self._scores(trial / np.linalg.norm(trial, axis=1, keepdims=True))
        total = scores[0]
        for s in scores[1:]:
            total = (total[:, :, None] + s[:, None, :]).reshape(len(trial), -1)
        self.least = float(np.quantile(total, 1 - each / self.words**self.blocks))

    def _scores(self, unit: np.ndarray) -> list[np.ndarray]:
        parts = np.split(unit @ self.turn, np.cumsum(self.cuts)[:-1], axis=1)
        return [p @ c.T for p, c in zip(parts, self.codes)]

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that each row belongs to."""
        scores = self._scores(unit)
        best = [s.max(axis=1) for s in scores]
        row = np.arange(len(unit))
        key, total = np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for b, s in enumerate(scores):
            reach = sum(best[b + 1 :], np.zeros(len(unit)))
            sums = total[:, None] + s[row]
            at, word = np.nonzero(sums >= (self.least - reach[row])[:, None])
            row, key, total = row[at], key[at] * self.words + word, sums[at, word]
        return row, key


_CODES: dict[int, list[ProductCode]] = {}


def filters(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) over all codes; keys of vectors of other sizes differ."""
    size = unit.shape[1]
    if size not in _CODES:
        _CODES[size] = [ProductCode(size, k) for k in range(_shape(size)[0])]
    rows, keys = [], []
    for at in range(0, len(unit), 256):
        for k, code in enumerate(_CODES[size]):
            row, key = code.filters(unit[at : at + 256])
            rows.append(row + at)
            keys.append(key | (np.int64(k) << 24) | (np.int64(size) << 32))
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    return row[order], key[order]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; scaled first, so that no square overflows."""
    x = np.asarray(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node) of every filter of every class."""
    for batch in batches:
        node = batch.column(batch.schema.get_field_index("node")).to_numpy()
        lists = batch.column(batch.schema.get_field_index("embedding"))
        size = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        start = np.cumsum(size) - size
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            for at in range(0, len(own), 1024):
                some = own[at : at + 1024]
                row, key = filters(unit_rows(flat[start[some][:, None] + np.arange(n)]))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[some][row])], names=["key", "node"])


def _column(group: pa.Table, name: str) -> np.ndarray:
    return group.column(name).to_numpy()


def _ragged(group: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    lists = group.column(name).combine_chunks()
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def _compared(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    names = ["node", "links", "root"]
    held: list[list[np.ndarray]] = [[], [], []]
    for group in groups(batches, ["key", "p", "q"]):
        node = _column(group, "node")
        flat, size = _ragged(group, "embedding")
        unit = unit_rows(flat.reshape(len(node), size[0]))
        near = unit @ unit.T >= cosine
        np.fill_diagonal(near, False)
        if not near.any():
            continue
        own, key = _column(group, "own"), group.column("key")[0].as_py()
        p, q, chunks = (group.column(n)[0].as_py() for n in ("p", "q", "chunks"))
        # a pair counts in the smallest of the filters it shares; those of the linked members are listed again
        linked = np.flatnonzero(near.any(axis=1))
        row, found = filters(unit[linked])
        row, found = row[found < key], found[found < key]
        places, index = np.unique(found, return_inverse=True)
        belongs = np.zeros((len(node), len(places)), np.float32)
        belongs[linked[row], index] = 1
        counted = near & (belongs @ belongs.T == 0)
        # and, of the parts in which a chunk meets itself, in the one it shares with the chunk after it
        partner = np.where(own == p, q, p)
        here = (chunks == 1) | (partner == (own + 1) % chunks)
        counted &= (own[:, None] != own[None, :]) | here[:, None]
        links = counted @ _column(group, "n").astype(np.float64)
        label = forest(len(node), lambda i: np.flatnonzero(near[i]))
        root = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(root, label, node)
        some = near.any(axis=1)
        for store, x in zip(held, (node[some], links[some].astype(np.int64), root[label][some])):
            store.append(x)
        if sum(map(len, held[0])) >= 65536:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in held], names=names)
            held = [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.int64)])) for x in held], names=names)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: how many other vectors it is linked to, the smallest vec_id reachable, and whether that is its own.

    Equal vectors are linked with each other and compared as one. Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing; vectors of different sizes do not link. vec_id is a key: rows that repeat an id with the same vector count as further vectors, those with another
    vector share one component. A row without vec_id links with nothing, and its component and kept are null. Of the pairs at the threshold nearly all share
    a filter (measured in the tests); none below it is linked. An empty table gives no rows."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.exists("embedding", lambda x: x != 0) & ~odd, F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("embedding", F.when(sound, F.col("embedding")))
    classes = rows.filter("embedding IS NOT NULL").groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
    classes = stored(classes, "vectors")
    listed = stored(spread(classes.select("node", "embedding"), "node").mapInArrow(_listed, "key long, node long"), "filters")
    met = members(listed, "key", "node")
    parts = chunked(met, "node").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int")).drop("size").join(classes, "node")
    dealt = bucket_order(parts, "key")
    compared = stored(dealt.mapInArrow(lambda x: _compared(x, cosine), "node long, links long, root long"), "compared")
    counts = compared.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = components(compared.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b")).withColumnRenamed("root", "component_id")
    named = classes.join(counts, "node", "left").join(rooted, "node", "left")
    named = named.select(
        "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component_id")
    )
    return rows.join(stored(named, "vector-classes"), "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def op9_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
