"""Buckets of colliding items: which have several members, how large ones are split, and how their links are found."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from harvestlens.llm.shared import by_shuffle, stored

# Members of a bucket that meet in one task at most: two chunks of about this many.
CHUNK = 256


def members(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, item, size) of the buckets with two members or more; rows hold each (key, item) once.

    Most keys stand alone, so they are only counted at first. Of buckets with the very same members one is kept: count, least, greatest and two
    checksums over the members tell. The groupings combine on the map side, so a bucket that holds a third of all rows is no heavy task."""
    several = rows.groupBy(key).agg(F.count("*").alias("size")).filter("size > 1")
    met = stored(rows.join(by_shuffle(several), key).select(key, item, "size"), "members")
    mark = F.xxhash64(item)
    whole = met.groupBy(key).agg(
        F.count("*").alias("size"), F.min(item).alias("lo"), F.max(item).alias("hi"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark)).alias("y"),
    )
    kept = whole.groupBy("size", "lo", "hi", "x", "y").agg(F.min(key).alias(key)).select(key)
    return met.join(by_shuffle(kept), key, "left_semi").select(key, item, "size")


def chunked(rows: DataFrame, item: str, size: str = "size", chunk: int = CHUNK) -> DataFrame:
    """Deal the members of large buckets to chunks and each pair of chunks to a part (p, q), p <= q. Every two members
    of a bucket meet in a part; a part holds two chunks at most. `own` is the chunk of a row."""
    count = F.ceil(F.col(size) / F.lit(chunk)).cast("int")
    dealt = rows.withColumn("_n", count).withColumn("own", F.pmod(F.xxhash64(F.lit(7), item), F.col("_n").cast("long")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    # a part of one chunk with itself is covered by any part that the chunk shares with another
    dealt = dealt.filter((F.col("_n") == 1) | (F.col("_other") != F.col("own")))
    return dealt.withColumn("p", F.least("own", "_other")).withColumn("q", F.greatest("own", "_other")).drop("_n", "_other")


def bucket_order(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key, "p", "q").sortWithinPartitions(key, "p", "q")


def forest(n: int, linked_to: Callable[[int], np.ndarray]) -> np.ndarray:
    """Component number of each of n members, where linked_to(i) gives the members that i is linked to.

    Members of the largest component need not be asked: a link between two components has an end outside it, and every
    member outside is asked. So a dense group costs a few calls, not one for each pair."""
    label = np.arange(n)
    asked = np.zeros(n, bool)
    while True:
        sizes = np.bincount(label, minlength=n)
        main = int(sizes.argmax())
        if sizes[main] == n:
            return label
        left = np.flatnonzero(~asked & (label != main)) if sizes[main] > 1 else np.flatnonzero(~asked)
        if not len(left):
            return label
        for i in left[:16]:
            asked[i] = True
            touched = np.unique(label[np.append(linked_to(int(i)), i)])
            if len(touched) > 1:
                label[np.isin(label, touched)] = touched[0]


def packed(*parts: tuple[Column, int]) -> Column:
    """One long out of (value, bits) columns."""
    out = F.lit(0).cast("long")
    for value, bits in parts:
        out = F.shiftleft(out, bits).bitwiseOR(value.cast("long"))
    return out
