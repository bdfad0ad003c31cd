"""Exact copies among lessons, with frequent bodies kept out of the shuffle.

Method: heavy-hitter split.  A Misra-Gries summary of at most ``counters`` digests per
task finds every digest with more than rows / (counters + 1) copies.  These candidates
(at most ``counters`` rows, so safe to broadcast) are counted exactly and their winners
are broadcast for a map-side lookup; all other digests go through an ordinary shuffle, in
which no group holds more than that share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.scale import materialize

SPACES = r"[\x20\x09-\x0D]+"


def body_digest(body: str):
    """SHA-256 (hex) of the body with each run of white space as one space; null counts as empty."""
    return F.sha2(F.encode(F.regexp_replace(F.coalesce(body, F.lit("")), SPACES, " "), "utf-8"), 256)


def _trim(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """Keep at most ``counters`` entries; the next largest count is taken off all of them."""
    if len(counts) <= counters:
        return counts
    off = sorted(counts.values(), reverse=True)[counters]
    return {k: c - off for k, c in counts.items() if c > off}


def frequent(digests: DataFrame, digest: str, counters: int) -> DataFrame:
    """At most ``counters`` digests, among them each that more than rows / (counters + 1) rows have."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            seen = pc.value_counts(batch.column(0))
            for k, c in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist()):
                counts[k] = counts.get(k, 0) + c
            counts = _trim(counts, counters)
        if counts:
            yield pa.RecordBatch.from_pydict({digest: list(counts), "weight": pa.array(counts.values(), pa.int64())})

    summary = digests.select(digest).mapInArrow(summarise, f"{digest} binary, weight bigint")
    return summary.groupBy(digest).agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), digest).limit(counters).select(digest)


def collapse_copies(lessons: DataFrame, counters: int = 1000) -> DataFrame:
    """One row per lesson with the copy that stays for it.

    lessons: ``lesson_id`` bigint, ``body`` string; further columns are not read.  Bodies
    are equal when identical after replacing each run of space and 09-0D by one space; a
    null body counts as empty.  Of equal bodies the one with the smallest ``lesson_id``
    stays (a null id only if there is no other; of rows with the same id one stays).
    Returns ``lesson_id``, ``keep_id``, ``group_size``, ``kept``, ``body_sha256``.  An
    empty table gives an empty result.

    ``counters`` bounds the rows that are broadcast.
    """
    rows = materialize(lessons.select(
        F.col("lesson_id").cast("bigint").alias("lesson_id"), F.unhex(body_digest("body")).alias("digest"),
        F.monotonically_increasing_id().alias("at")))
    winner = [F.min(F.struct(F.col("lesson_id").isNull(), "lesson_id", "at")).alias("winner"), F.count("*").alias("group_size")]
    heavy = materialize(rows.join(F.broadcast(frequent(rows, "digest", counters)), "digest").groupBy("digest").agg(*winner))
    split = rows.join(F.broadcast(heavy), "digest", "left")
    rest = split.where(F.col("group_size").isNull()).select(rows.columns)
    found = split.where(F.col("group_size").isNotNull()).unionByName(rest.join(rest.groupBy("digest").agg(*winner), "digest"))
    return found.select(
        "lesson_id", F.col("winner.lesson_id").alias("keep_id"), "group_size", (F.col("at") == F.col("winner.at")).alias("kept"),
        F.lower(F.hex("digest")).alias("body_sha256"))
