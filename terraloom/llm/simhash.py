"""Near copies among lessons by SimHash, found with covering locality-sensitive hashing.

A lesson's fingerprint has a bit for each bit of a 64-bit hash, set where more than half
of the lesson's shingles have it set.  Lessons whose fingerprints differ in at most
``radius`` bits are linked.

Method: covering masks.  Each bit position gets a non-zero code of ``radius`` + 1 bits;
mask v holds the positions whose code has odd parity with v.  The codes of ``radius``
differing positions span at most ``radius`` dimensions, so some v is orthogonal to all of
them: under its mask the two fingerprints are equal.  Hence the 2**(radius + 1) - 1 tables
bring together every pair within the radius, without chance.  A bucket of more than
``bucket`` fingerprints is dealt again, by the same construction over the positions that
its mask leaves free; as this leaves ever fewer positions, buckets become small by
themselves and none is cut.  A task returns a forest of links, not the pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm import bpe
from terraloom.llm import words as w
from terraloom.operators.network import connected_components, joined_labels
from terraloom.scale import materialize, release

BITS = 64
ALL = (1 << BITS) - 1
PIECE = 1 << 15  # shingles hashed at once
LOT = 400_000  # rows of a task


def fingerprint(body: bytes, shingle: int = 3) -> int:
    """SimHash of one text: words in lower case (A-Z only), XXH64 with seed 42 of each run of ``shingle`` words."""
    words = body.lower().split()  # bytes are split at 20 and 09-0D only
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, count = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, len(starts), PIECE):
        h = np.array([digest(text[a:b], 42) for a, b in zip(starts[k : k + PIECE].tolist(), ends[k : k + PIECE].tolist())], w.U)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * count > len(starts))))


def fingerprints(lessons: DataFrame, shingle: int = 3) -> DataFrame:
    """``lesson_id``, ``fingerprint`` (its 64 bits as bigint) of every whole body; null is empty."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in bpe.slices(batch["body"]):
                data, offsets = w.column_bytes(batch["body"].slice(a, b - a))
                raw = data.tobytes()
                values = [fingerprint(raw[p:q], shingle) for p, q in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_pydict({
                    "lesson_id": batch["lesson_id"].slice(a, b - a), "fingerprint": pa.array(np.array(values, w.U).view(np.int64))})

    return lessons.selectExpr("cast(lesson_id as bigint) lesson_id", "body").mapInArrow(w.tidy(make), "lesson_id bigint, fingerprint bigint")


def masks(positions: Sequence[int], radius: int) -> list[int]:
    """Covering masks over ``positions``: any two values that differ in at most ``radius`` of them agree under one mask."""
    codes = 2 ** (radius + 1) - 1
    code = {p: 1 + i % codes for i, p in enumerate(positions)}
    return [sum(1 << p for p in positions if (code[p] & v).bit_count() % 2) for v in range(1, codes + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _free(mask: int) -> list[int]:
    return [p for p in range(BITS) if mask >> p & 1]


def _dealt(rows: DataFrame, free: int, radius: int, trail: int) -> DataFrame:
    """Rows (fingerprint, table, bucket) by each covering mask over the positions in ``free``; all other positions count in full."""
    fixed = ~free & ALL
    keys = [F.xxhash64(F.lit(trail + i), F.col("fingerprint").bitwiseAND(F.lit(_signed(m | fixed)))) for i, m in enumerate(masks(_free(free), radius))]
    return rows.select("fingerprint", F.posexplode(F.array(*keys)).alias("table", "bucket")).withColumn("table", F.col("table") + trail)


def near_links(bucket: np.ndarray, value: np.ndarray, radius: int) -> np.ndarray:
    """Index of the component of each row along pairs in one bucket that differ in at most ``radius`` bits.

    Rows are sorted by bucket; equal values are one node across buckets.
    """
    kinds, node = np.unique(value, return_inverse=True)
    label = np.arange(len(kinds))
    start = w.firsts(bucket)
    size = np.diff(np.append(start, len(bucket)))
    left = np.repeat(size + start, size) - np.arange(len(bucket)) - 1  # rows of the bucket that follow
    a, b = [], []
    at = np.flatnonzero(left > 0)
    step = 1
    while len(at):
        near = at[np.bitwise_count(value[at] ^ value[at + step]) <= radius]
        x, y = node[near], node[near + step]
        a.append(x)
        b.append(y)
        if sum(map(len, a)) > 4 * len(kinds) + 1_000_000:
            label = joined_labels(label, np.concatenate(a), np.concatenate(b))
            a, b = [], []
        step += 1
        at = at[left[at] >= step]
    label = joined_labels(label, np.concatenate(a), np.concatenate(b)) if a else label
    return kinds[label][node]


def _forest(radius: int):
    def links(table: pa.Table) -> pa.Table:
        bucket, value = (np.asarray(table[c].to_numpy(), np.int64) for c in ("bucket", "fingerprint"))
        order = np.argsort(bucket, kind="stable")
        value = value[order].view(w.U)
        root = near_links(bucket[order], value, radius)
        away = root != value
        pairs = np.unique(np.stack([value[away], root[away]]), axis=1)
        return pa.table({"src": pa.array(pairs[0].view(np.int64)), "dst": pa.array(pairs[1].view(np.int64))})

    return links


def links(values: DataFrame, radius: int = 2, bucket: int = 512) -> DataFrame:
    """Edges (src, dst) that connect all ``fingerprint`` values within ``radius`` bits of each other; values are distinct.

    ``bucket``: larger buckets are dealt again over the positions still free, as long as
    that leaves some; a bucket with f free positions has at most 2**f values.
    """
    tables = 2 ** (radius + 1) - 1
    open_ = [(values, ALL)]  # rows, and the positions in which those of a bucket may differ
    made, held, trail = [], [], 0
    while open_:
        free_of = {trail + n * tables + t: free & ~m for n, (_, free) in enumerate(open_) for t, m in enumerate(masks(_free(free), radius))}
        dealt = [_dealt(rows, free, radius, trail + n * tables) for n, (rows, free) in enumerate(open_)]
        members = reduce(DataFrame.unionByName, dealt)
        sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        members = materialize(members.join(sizes, "bucket"))
        held.append(members)
        rest = max(x.bit_count() for x in free_of.values())
        whole = 2**rest <= 8 * bucket or rest == max(free.bit_count() for _, free in open_)
        small = members if whole else members.where(F.col("size") <= bucket)
        lots = max(w.shuffle_width(members), -(-small.count() // LOT))
        small = small.select("bucket", "fingerprint", F.pmod(F.hash("bucket"), F.lit(lots)).alias("lot"))
        made.append(small.groupBy("lot").applyInArrow(_forest(radius), "src bigint, dst bigint"))
        large = [] if whole else sorted(r["table"] for r in members.where(F.col("size") > bucket).select("table").distinct().collect())  # a few numbers
        trail += len(free_of)
        open_ = [(members.where((F.col("table") == t) & (F.col("size") > bucket)), free_of[t]) for t in large]
    out = materialize(reduce(DataFrame.unionByName, made).distinct())
    release(*held)
    return out


def near_fingerprints(lessons: DataFrame, radius: int = 2, shingle: int = 3, bucket: int = 512) -> DataFrame:
    """One row per lesson with its fingerprint and the component of linked lessons it belongs to.

    lessons (the texts of a course): ``lesson_id`` bigint, ``body`` string; further columns
    are not read.  Words are runs of other bytes than 20 and 09-0D after lower-casing A-Z;
    a lesson of fewer words than ``shingle`` has one shingle, all of it; one without words
    (null and empty bodies too) has fingerprint zero and is linked like any other.  Bits
    set in exactly half the shingles are 0.  Fingerprints that differ in at most ``radius``
    bits are linked; no such pair is missed.

    Returns ``lesson_id``, ``fingerprint`` (16 lower-case hexadecimal digits),
    ``component_id`` (least lesson_id reachable along links, itself included; null only if
    all ids of the component are null).  Repeated rows and ids each keep their row.  An
    empty table gives an empty result.
    """
    rows = materialize(fingerprints(lessons, shingle))
    least = materialize(rows.groupBy("fingerprint").agg(F.min("lesson_id").alias("least")))
    edges = links(least.select("fingerprint"), radius, bucket)
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    parts = connected_components(ends, edges).withColumnRenamed("node", "fingerprint")
    least = least.join(parts, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    named = least.groupBy("component").agg(F.min("least").alias("component_id"))
    known = least.join(named, "component").select("fingerprint", "component_id")
    return rows.join(known, "fingerprint").select("lesson_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
