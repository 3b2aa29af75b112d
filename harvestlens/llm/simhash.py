"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Three differing bits over three segments leave either

* one segment equal and another with one differing bit at most, or
* one differing bit in every segment.

For the first case the keys are (an equal segment, a codeword index of another); for the second, codeword indices of all three.
A segment's indices are those of the codewords nearest to it and to all values one bit away, so that two segments one bit apart
share one. Fingerprints that share a key meet in a bucket, are compared, and give links for the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestlens.llm.buckets import bucket_order, chunked, forest, members
from harvestlens.llm.components import components
from harvestlens.llm.golay import decode, near_indices
from harvestlens.llm.shared import by_shuffle, groups, in_small_batches, quoted, spread, stored, table, text_blocks

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bit i is set if it is set in over half the hashes of the text's word shingles, repeats included. A text shorter
    than a shingle is hashed whole; one without words has fingerprint zero."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(w) for w in zip(*(words[i:] for i in range(width)))] if len(words) >= width else [b" ".join(words)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 65536):
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[at : at + 65536]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(2 * ones > len(shingles), bitorder="little")
    return int(set_bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t) for _, _, texts in text_blocks(batch, "text") for t in texts]
        kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(prints, pa.int64())], names=[*names, "fp"])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return in_small_batches(rows).mapInArrow(_fingerprints, "doc_id long, fp long")


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all bucket keys of 64-bit fingerprints, each once."""
    bits = prints.view(np.uint64)
    part = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [near_indices(part[i], SEGMENTS[i][1]) for i in range(3)]
    exact = [decode(p) for p in part]
    rows, keys = [], []
    case = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                row, col = np.nonzero(near[j][1])
                rows.append(row)
                keys.append((np.int64(case) << 36) | (part[i][row] << 12) | near[j][0][row, col])
                case += 1
    # one bit off in each segment: one side gives indices of the first two segments, the other side of the third
    r0, c0 = np.nonzero(near[0][1])
    at = np.searchsorted(r0, np.arange(len(bits) + 1))
    row1, col1 = np.nonzero(near[1][1])
    times = np.diff(at)[row1]
    pick = np.repeat(at[row1], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    row = np.repeat(row1, times)
    rows.append(row)
    keys.append((np.int64(case) << 36) | (near[0][0][r0[pick], c0[pick]] << 24) | (np.repeat(near[1][0][row1, col1], times) << 12) | exact[2][row])
    row, col = np.nonzero(near[2][1])
    index = near[2][0][row, col]
    other = index != exact[2][row]
    row, index = row[other], index[other]
    rows.append(row)
    keys.append((np.int64(case) << 36) | (exact[0][row] << 24) | (exact[1][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 4096):
            own = prints[at : at + 4096]
            row, key = keys_of(own)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], names=["key", "fp"])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for group in groups(batches, ["key", "p", "q"]):
        prints = np.unique(group.column("fp").to_numpy())
        bits = prints.view(np.uint64)
        label = forest(len(prints), lambda i: np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= DISTANCE))
        first = np.unique(label, return_index=True)[1]
        root = np.zeros(len(prints), np.int64)
        root[label[first]] = prints[first]
        linked = root[label] != prints
        a.extend(prints[linked].tolist())
        b.extend(root[label][linked].tolist())
        if len(a) >= 65536:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that join all fingerprints at three or fewer differing bits into the same components; `prints` has
    each fingerprint once. A bucket gives one link a member and part, not all pairs."""
    rows = spread(prints.select("fp"), "fp").mapInArrow(_keyed, "key long, fp long")
    colliding = chunked(members(rows, "key", "fp"), "fp")
    return bucket_order(colliding.select("key", "p", "q", "fp"), "key").mapInArrow(_bucket_links, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: 16 hex digits, and the smallest doc_id reachable over links.

    Equal fingerprints are linked, those of texts without words (null, empty, white space: zero) as well. Repeated rows give
    repeated results. A row without doc_id is linked by its text but names no component; where no id is in a component,
    component_id is null. An empty table gives no rows.
    """
    rows = stored(with_fingerprints(docs, doc_id, text), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = components(links(classes)).select(F.col("node").alias("fp"), "root")
    held = classes.join(by_shuffle(rooted), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = held.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(held.join(by_shuffle(least), "root").select("fp", "component_id"), "components")
    return rows.join(by_shuffle(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id. Rows that repeat a doc_id are one document
    and share its fate; rows without doc_id stay."""
    marked = near_duplicates(docs).select("doc_id", "component_id").filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(marked, "doc_id", "left_anti").select([quoted(c) for c in docs.columns])


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
