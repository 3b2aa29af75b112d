"""Secret scan: base patterns, and strings whose sliding windows are too mixed for words.

A candidate is a maximal run of letters, digits and + / _ = - of WINDOW characters or more. Every window of WINDOW characters in it is
classed by the characters that it holds, and has a Shannon entropy. Moving a window by one drops a character and takes one in, so its sum of
c * log2(c) over its counts c changes by two terms; the sums are kept as whole numbers and do not drift. Windows at or over the threshold of
their class are joined to spans. A candidate in which an allow-list pattern is found gives none, and a span inside a base match is that match.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from harvestlens.llm.shared import in_small_batches, table, text_blocks

WINDOW = 20
# Bits a character of the windows of each class.
THRESHOLDS = {"hex": 3.0, "mixed": 3.75}
# The kinds of the base and the fewest characters of what each finds.
BASE = (("assign", 6), ("access", 20), ("hex", 24))
ENTROPY = "entropy"
# The base patterns; the first one on lower-cased text.
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
KEYWORDS = (b"passw", b"secret", b"token", b"api")
# Candidates that are known not to be secrets: identifiers, alphabets and names of examples.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"0123456789|9876543210",
    r"ABCDEFGHIJKL|abcdefghijkl",
    r"EXAMPLE|Example|example|PLACEHOLDER|placeholder",
)
SPANS = "array<struct<kind:string,start:long,end:long>>"


def _table(members: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members.encode())] = True
    return out


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CANDIDATE = _table(DIGITS + LOWER + UPPER + "+/_=-")


def window_sums(codes: np.ndarray, run: np.ndarray, width: int) -> np.ndarray:
    """For each place the sum of c * log2(c), times 2**32 and rounded, over the counts c of the last `width` characters of the same run.

    `run` numbers the runs, in order. What a place takes in and drops is found by its place among the equal characters of the run."""
    n = len(codes)
    term = np.array([0, *(round(c * math.log2(c) * 2**32) for c in range(1, width + 1))], np.int64)
    place = np.arange(n)
    key = run.astype(np.int64) << 8 | codes
    order = np.argsort(key, kind="stable")
    sorted_key = key[order] * np.int64(n) + order
    rank = np.empty(n, np.int64)
    rank[order] = place
    # how many equal characters stand among the `width - 1` places before
    first = np.searchsorted(sorted_key, key * np.int64(n) + np.maximum(place - width + 1, 0))
    before = rank - first
    taken = term[np.minimum(before, width - 1) + 1] - term[np.minimum(before, width - 1)]
    # the character that leaves stood `width` places before; among the places after it up to here, its equals are counted without the one that comes in
    gone = place - width
    there = np.flatnonzero((gone >= 0) & (run == run[np.maximum(gone, 0)]))
    left = gone[there]
    last = np.searchsorted(sorted_key, key[left] * np.int64(n) + there)
    after = last - rank[left]
    dropped = np.zeros(n, np.int64)
    dropped[there] = term[after] - term[after - 1]
    change = np.cumsum(taken - dropped)
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    base = np.concatenate(([0], change))[starts]
    return change - np.repeat(base, np.diff(np.append(starts, n)))


def hot_windows(codes: np.ndarray, run: np.ndarray, width: int, thresholds: dict[str, float]) -> np.ndarray:
    """Where a window of `width` characters begins that reaches the threshold of its class."""
    n = len(codes)
    if n < width:
        return np.zeros(0, np.int64)
    begin = np.arange(n - width + 1)
    begin = begin[run[begin] == run[begin + width - 1]]
    entropy = math.log2(width) - window_sums(codes, run, width)[begin + width - 1] / 2**32 / width

    def held(members: str) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(_table(members)[codes])))
        return total[begin + width] - total[begin]

    digits, lower, upper = held(DIGITS), held(LOWER), held(UPPER)
    letters = held("abcdefABCDEF")
    is_hex = (digits > 0) & (letters > 0) & (digits + letters == width)
    mixed = (digits > 0) & (lower > 0) & (upper > 0)
    return begin[is_hex & (entropy >= thresholds["hex"]) | mixed & (entropy >= thresholds["mixed"])]


def spans_of(texts: list[bytes], width: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS, allowed: tuple[str, ...] = ALLOWED) -> list[list[tuple[int, int, str, int]]]:
    """(start, place of its kind, kind, end) of the spans of each text, in order; code points, end exclusive."""
    fewest = min(width, *(n for kind, n in BASE if kind != "assign"))
    least, order = dict(BASE), {kind: i for i, (kind, _) in enumerate((*BASE, (ENTROPY, 0)))}
    assign, access, hexes, allow = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX), re.compile("|".join(allowed).encode()) if allowed else None
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for i, text in enumerate(texts):
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            found[i] += [(m.start(), m.end(), "assign") for m in assign.finditer(low) if m.end(2) - m.start(2) >= least["assign"]]
    # what the other kinds find lies inside runs of candidate characters
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = np.concatenate(([False], CANDIDATE[raw], [False])).view(np.int8)
    flips = np.flatnonzero(np.diff(inside))
    begin, end = flips[::2], flips[1::2]
    long = end - begin >= fewest
    begin, end = begin[long], end[long]
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    of = np.searchsorted(first, begin, side="right") - 1
    strings = [raw[b:e].tobytes() for b, e in zip(begin, end)]
    for i, string, at in zip(of.tolist(), strings, (begin - first[of]).tolist()):
        for kind, pattern in (("access", access), ("hex", hexes)):
            found[i] += [(at + m.start(), at + m.end(), kind) for m in pattern.finditer(string) if m.end() - m.start() >= least[kind]]
    kept = [k for k, string in enumerate(strings) if len(string) >= width and not (allow and allow.search(string))]
    if kept:
        sizes = np.array([len(strings[k]) for k in kept])
        run = np.repeat(np.arange(len(kept)), sizes)
        hot = hot_windows(np.frombuffer(b"".join(strings[k] for k in kept), np.uint8), run, width, thresholds)
        fresh = np.flatnonzero((np.diff(hot, prepend=-width - 1) > width) | (np.diff(run[hot], prepend=-1) != 0))
        shift = np.concatenate(([0], np.cumsum(sizes)))
        last = np.append(fresh, len(hot))[1:] - 1 if len(hot) else fresh
        for b, e in zip(hot[fresh].tolist(), (hot[last] + width).tolist()):
            k = kept[run[b]]
            at = int(begin[k] - first[of[k]] - shift[run[b]])
            base = found[of[k]]
            if not any(s <= at + b and at + e <= t and kind != ENTROPY for s, t, kind in base):
                base.append((at + b, at + e, ENTROPY))
    return [sorted((s, order[kind], kind, e) for s, e, kind in _code_points(text, spans)) for text, spans in zip(texts, found)]


def _code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if not spans or text.isascii():
        return spans
    # bytes that go on a character
    more = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)
    at = lambda x: x - int(np.searchsorted(more, x))
    return [(at(s), at(e), kind) for s, e, kind in spans]


def _found(batches: Iterator[pa.RecordBatch], width: int, thresholds: dict[str, float], allowed: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for start, end, texts in text_blocks(batch, "text"):
            spans = [[{"kind": kind, "start": s, "end": e} for s, _, kind, e in own] for own in spans_of(texts, width, thresholds, allowed)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), pa.array(spans, shape)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame, width: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(doc_id, spans) for every row; spans are (kind, start, end) in code points, by start and then kind, end exclusive.

    A null text is empty and has no spans. Rows that repeat have the same spans each, rows without doc_id are scanned like any other, further columns are
    not read, and an empty table gives no rows. Every kind finds its leftmost matches that do not overlap; spans of different kinds may."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_small_batches(rows).mapInArrow(lambda x: _found(x, width, thresholds, allowed), f"doc_id long, spans {SPANS}")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(kind) for kind, _ in BASE), F.sha2(said(F.filter("spans", lambda s: s["kind"] != ENTROPY)), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )


def scan_sql() -> str:
    """The same by brute force: each window's entropy anew."""
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join([either("password"), either("passwd"), either("secret"), either("token"), f"{either('api')}_?{either('key')}"])
    value = "[A-Za-z0-9+/_.=-]+"
    before = f"""(?:{words})["'']?\\x20*[:=]\\x20*["'']?"""
    patterns = {"assign": before + value, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "run": f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"}

    def places(kind: str, pattern: str) -> str:
        pieces = f"string_split_regex(text, '{pattern}')"
        return f"""SELECT rid, '{kind}' AS kind, match, CAST(start AS BIGINT) AS start FROM (
            SELECT rid, unnest(matches) AS match, unnest(list_transform(range(1, len(matches) + 1), lambda i: list_sum(list_transform(pieces[:i], lambda p: length(p)))
                + coalesce(list_sum(list_transform(matches[:i - 1], lambda m: length(m))), 0))) AS start
            FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS matches, {pieces} AS pieces FROM docs) WHERE len(matches) > 0)"""

    size = {"assign": f"length(regexp_replace(match, '^{before}', ''))", "access": "length(match)", "hex": "length(match)"}
    kept = " OR ".join(f"kind = '{kind}' AND {size[kind]} >= {n}" for kind, n in BASE)
    order = "CASE kind " + " ".join(f"WHEN '{kind}' THEN {i}" for i, (kind, _) in enumerate(BASE)) + f" ELSE {len(BASE)} END"
    hit = lambda cls: f"regexp_matches(w, '{cls}')"
    said = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    placed AS ({' UNION ALL '.join(places(k, p) for k, p in patterns.items())}),
    base AS (SELECT rid, kind, start, start + length(match) AS stop FROM placed WHERE {kept}),
    windows AS (SELECT rid, start AS run, start + i AS pos, substring(match, CAST(i + 1 AS BIGINT), {WINDOW}) AS w
                FROM (SELECT rid, match, start, unnest(range(length(match) - {WINDOW - 1})) AS i FROM placed WHERE kind = 'run' AND NOT regexp_matches(match, '{"|".join(ALLOWED)}'))),
    hot AS (SELECT rid, run, pos FROM (SELECT *, list_aggregate(string_split(w, ''), 'entropy') AS bits FROM windows)
            WHERE ({hit('^[0-9a-fA-F]+$')} AND {hit('[0-9]')} AND {hit('[a-fA-F]')} AND bits >= {THRESHOLDS['hex']})
               OR ({hit('[0-9]')} AND {hit('[a-z]')} AND {hit('[A-Z]')} AND bits >= {THRESHOLDS['mixed']})),
    islands AS (SELECT *, sum(CASE WHEN pos - before <= {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY rid, run ORDER BY pos) AS island
                FROM (SELECT *, lag(pos) OVER (PARTITION BY rid, run ORDER BY pos) AS before FROM hot)),
    merged AS (SELECT rid, min(pos) AS start, max(pos) + {WINDOW} AS stop FROM islands GROUP BY rid, run, island),
    added AS (SELECT rid, '{ENTROPY}' AS kind, start, stop FROM merged m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = m.rid AND b.start <= m.start AND m.stop <= b.stop)),
    spans AS (SELECT *, {order} AS place FROM (SELECT * FROM base UNION ALL SELECT * FROM added)),
    digest AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
               string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (kind <> '{ENTROPY}') AS base, {said} AS spans FROM spans GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN digest USING (rid)"""
